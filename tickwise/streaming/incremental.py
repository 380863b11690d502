"""Incremental ingestion and scoring with Structured Streaming.

The reference appends to CSV files in loops (one API call per day, a flush
every 10 scored rows).  Here new files landing in a folder are a file-source
stream.  The keys seen so far are the state of a streaming ``dropDuplicates`` in
a RocksDB state store: a micro-batch looks up its own keys and nothing of the
sink is read again, however much it holds.  There is no watermark, so the state
keeps every key and a row is judged by its key alone: late repeats go, late new
rows stay, after a restart as well.  Each micro-batch is written by
``foreachBatch`` into its own ``batch_id=<n>`` folder; a replayed batch gets the
same rows from the same state version and replaces its own output
(exactly-once with the checkpointed offsets and state).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",  # a batch uploads its changes only
}
FLUSHES = 16  # flushes of one micro-batch at most: a flush is a job of its own, which no number of executors shortens
FILE_ROWS = 1_000_000  # rows of a landed file, about


def stream_ingest(spark: SparkSession, source_dir: str, schema: T.StructType, sink: str, checkpoint: str,
                  key: str, max_files: int = 1):
    """S9 (stream form): land new files, keep the first row of each key, append.

    Runs over the files present (``availableNow``); a later call continues from
    the checkpoint, with the keys of all earlier calls.
    """
    return stream_score(spark, source_dir, schema, sink, checkpoint, key, score=lambda d: d, max_files=max_files)


def stream_score(spark: SparkSession, source_dir: str, schema: T.StructType, sink: str, checkpoint: str,
                 key: str, score: Callable[[DataFrame], DataFrame], max_files: int = 1, flush_rows: int | None = None):
    """N7 (stream form): each micro-batch scores the rows of keys that no earlier batch held.

    ``flush_rows``: about so many rows are scored and written at a time, in a batch of
    up to ``FLUSHES`` times as many; a larger batch is flushed in ``FLUSHES`` parts,
    each scored by many tasks.  Parts that are complete when a batch is replayed are
    not scored again, so a failure costs at most one part of a slow scorer's work.
    A batch's rows are staged in a folder per hash of the key, and a part reads its own
    folders only, so every row is read once.  A null key is a key; the column name
    ``_flush`` is reserved.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        out = f"{sink.rstrip('/')}/batch_id={batch_id}"
        if flush_rows is None:
            score(batch).write.mode("overwrite").parquet(out)
            return
        spark_ = batch.sparkSession
        staged = f"{sink.rstrip('/')}/_staged/batch_id={batch_id}"  # names with an underscore are no part of the table
        dealt = batch.withColumn("_flush", F.pmod(F.xxhash64(key), F.lit(FLUSHES)).cast("int"))
        # each folder is written by as many tasks as the session's shuffles have for it
        tasks = int(spark_.conf.get("spark.sql.shuffle.partitions"))
        spread = F.pmod(F.hash(key), F.lit(max(1, tasks // FLUSHES)))
        dealt.repartition(tasks, "_flush", spread).write.mode("overwrite").partitionBy("_flush").parquet(staged)
        rows = spark_.read.schema(dealt.schema).parquet(staged)
        parts = min(FLUSHES, max(1, -(-rows.count() // flush_rows)))
        for part in range(parts):
            done = f"{out}/part={part}"
            if not _exists(spark_, f"{done}/_SUCCESS"):
                own = rows.filter(F.col("_flush").isin(list(range(part, FLUSHES, parts)))).drop("_flush")
                score(own).write.mode("overwrite").parquet(done)

    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        q = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source_dir).dropDuplicates([key])
             .writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return q


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_sink(spark: SparkSession, sink: str) -> DataFrame:
    """All micro-batch folders of a sink, without the folders' columns."""
    return spark.read.parquet(sink).drop("batch_id", "part")


def land_files(df: DataFrame, folder: str, parts: list) -> None:
    """Write ``df`` as a sequence of arrivals: one append per filter in ``parts``.

    ``df`` is read by as many tasks as it has splits.  An arrival is one file per
    ``FILE_ROWS`` rows: its rows are moved to their files by a shuffle, so no task
    reads the whole of ``df``.
    """
    rows = df.agg(*[F.count_if(cond).alias(f"n{i}") for i, cond in enumerate(parts)]).first()
    for n, cond in zip(rows, parts, strict=True):
        df.filter(cond).repartition(max(1, -(-n // FILE_ROWS))).write.mode("append").parquet(folder)


__all__ = ["stream_ingest", "stream_score", "read_sink", "land_files", "F"]
