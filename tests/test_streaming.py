"""Incremental ingestion: each key once, restarts add nothing, new files add only new keys."""

from pyspark.sql import functions as F

from tickwise.sources.files import scratch_path
from tickwise.sources import views
from tickwise.streaming import incremental as INC

from .conftest import SF_SMALL


def test_stream_ingest_is_idempotent_and_incremental(spark):
    n = views.news(spark, SF_SMALL).select("id", "stock_id", "title")
    landing, sink, ckpt = scratch_path(spark, "t-land"), scratch_path(spark, "t-sink"), scratch_path(spark, "t-ckpt")
    INC.land_files(n, landing, [F.col("id") < 100, F.col("id") % 10 == 0])
    INC.stream_ingest(spark, landing, n.schema, sink, ckpt, key="id")
    first = INC.read_sink(spark, sink)
    assert first.count() == first.select("id").distinct().count() == 100 + n.filter((F.col("id") >= 100) & (F.col("id") % 10 == 0)).count()
    # restart without new files: nothing is added
    INC.stream_ingest(spark, landing, n.schema, sink, ckpt, key="id")
    assert INC.read_sink(spark, sink).count() == first.count()
    # a new file that repeats old ids and brings new ones: only the new ids are added
    INC.land_files(n, landing, [F.col("id") >= 50])
    INC.stream_ingest(spark, landing, n.schema, sink, ckpt, key="id")
    final = INC.read_sink(spark, sink)
    assert final.count() == final.select("id").distinct().count() == n.count()


def test_late_rows_after_a_restart(spark):
    schema = "id long, ts timestamp_ntz, v string"
    landing, sink, ckpt = scratch_path(spark, "t-land"), scratch_path(spark, "t-sink"), scratch_path(spark, "t-ckpt")
    rows = lambda *ids, day=1: spark.createDataFrame([(i, None, f"v{i}") for i in ids], schema).withColumn(
        "ts", F.expr(f"timestamp_ntz'2024-01-01' + make_dt_interval({day})"))
    struct = rows(1).schema
    for batch in (rows(1, 2, 2, None, day=400), rows(3, None, day=500)):
        INC.land_files(batch, landing, [F.lit(True)])
        INC.stream_ingest(spark, landing, struct, sink, ckpt, key="id")
    # a year late: repeats go, new keys stay
    INC.land_files(rows(1, 3, 4, 5, day=0), landing, [F.lit(True)])
    INC.stream_ingest(spark, landing, struct, sink, ckpt, key="id")
    assert sorted((r.id or 0) for r in INC.read_sink(spark, sink).collect()) == [0, 1, 2, 3, 4, 5]


def test_batches_do_not_read_the_sink(spark):
    df = spark.range(300)
    landing, sink, ckpt = scratch_path(spark, "t-land"), scratch_path(spark, "t-sink"), scratch_path(spark, "t-ckpt")
    INC.land_files(df, landing, [F.col("id") < 200, F.col("id") >= 150])
    plans = []

    def score(batch):
        plans.append(batch._jdf.queryExecution().optimizedPlan().toString())
        return batch

    INC.stream_score(spark, landing, df.schema, sink, ckpt, "id", score)
    assert INC.read_sink(spark, sink).count() == 300
    assert all("Join" not in p and sink not in p for p in plans)


def test_flushed_parts_are_scored_once(spark):
    df = spark.range(1000)
    landing, sink, ckpt = scratch_path(spark, "t-land"), scratch_path(spark, "t-sink"), scratch_path(spark, "t-ckpt")
    INC.land_files(df, landing, [F.lit(True)])
    calls = []

    def score(batch, fails=None):
        calls.append(batch.count())
        if fails == len(calls):
            raise RuntimeError("the scorer is down")
        return batch.withColumn("score", F.col("id") * 2)

    import pytest
    with pytest.raises(Exception, match="scorer is down"):
        INC.stream_score(spark, landing, df.schema, sink, ckpt, "id", lambda d: score(d, 3), flush_rows=250)
    assert len(calls) == 3
    INC.stream_score(spark, landing, df.schema, sink, ckpt, "id", score, flush_rows=250)
    assert len(calls) == 5 and sum(calls) == 1000 + calls[2]  # the part that failed is done again, the first two are not
    got = INC.read_sink(spark, sink)
    assert got.columns == ["id", "score"] and got.agg(F.count("*"), F.countDistinct("id"), F.sum("score")).first()[:] == (1000, 1000, 999000)


def test_a_large_batch_has_few_flushes_and_each_reads_its_own_rows(spark):
    df = spark.range(2000).withColumn("id", F.when(F.col("id") > 0, F.col("id")))  # a null key is a key
    landing, sink, ckpt = scratch_path(spark, "t-land"), scratch_path(spark, "t-sink"), scratch_path(spark, "t-ckpt")
    INC.land_files(df, landing, [F.lit(True)])
    plans = []

    def score(batch):
        plans.append(batch._jdf.queryExecution().executedPlan().toString())
        return batch

    INC.stream_score(spark, landing, df.schema, sink, ckpt, "id", score, flush_rows=10)
    assert 1 < len(plans) <= INC.FLUSHES
    assert all("PartitionFilters: [" in p and "PartitionFilters: []" not in p for p in plans)
    assert INC.read_sink(spark, sink).agg(F.count("*"), F.count("id"), F.countDistinct("id"), F.sum("id")).first()[:] == (2000, 1999, 1999, 1999000)


def test_arrivals_are_read_by_many_tasks(spark, monkeypatch):
    import pyarrow as pa
    from pyspark import TaskContext

    def tagged(batches):
        for batch in batches:
            yield batch.set_column(1, "task", pa.array([TaskContext.get().partitionId()] * batch.num_rows))

    monkeypatch.setattr(INC, "FILE_ROWS", 100)
    df = spark.range(0, 800, 1, 8).withColumn("task", F.lit(-1)).mapInArrow(tagged, "id long, task long")
    landing = scratch_path(spark, "t-land")
    INC.land_files(df, landing, [F.col("id") < 750, F.col("id") < 50, F.col("id") < 0])
    got = spark.read.parquet(landing)
    assert got.filter("id >= 50").agg(F.count("*"), F.countDistinct("id")).first()[:] == (700, 700)
    assert got.filter("id < 50").groupBy("id").count().filter("count = 2").count() == 50
    assert got.select("task").distinct().count() == 8
    files = got.groupBy(F.input_file_name()).count().collect()
    assert len(files) == 8 + 1 and max(r["count"] for r in files) <= 100
