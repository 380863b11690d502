"""Shared helpers of the subpackage: tables, written intermediates, prefix sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import scratch_path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder (any path Spark can read)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage and gives the planner exact sizes; the files live under
    ``spark.checkpoint.dir``, so a lost executor loses nothing.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(df: DataFrame) -> Column:
    """192 bits that tell rows apart by all their columns: rows that share it are equal throughout.

    MD5 of the text, and a 64-bit hash of the columns with their null marks (a
    null alone would leave the hash as it is); maps are hashed as JSON.
    """
    parts = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        parts += [c.isNull(), F.to_json(c) if "map<" in field.dataType.simpleString() else c]
    text = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    return F.concat(F.hex(F.xxhash64(*parts)), F.lit("-"), text)


HOT = 1000   # a key of more than one in HOT of all rows is hot: there are fewer than HOT such keys


def join_counted(rows: DataFrame, keyed: DataFrame, keys: Sequence[str], n: str) -> DataFrame:
    """``rows`` with the row of ``keyed`` for their keys, which it holds once, with the number ``n`` of their rows.

    Rows of hot keys stay where they are: those keys, fewer than HOT, are broadcast.
    The others are shuffled.  Both frames should be written tables, as each is read twice.
    """
    hot = F.broadcast(keyed.where(F.col(n) * HOT > rows.count()))
    rest = rows.join(hot.select(*keys), list(keys), "left_anti").join(keyed, list(keys))
    return rows.join(hot, list(keys)).unionByName(rest)


def prefix_sum(df: DataFrame, by: Sequence[str], order: Sequence[Column], chunk: Column, value: str,
               name: str) -> DataFrame:
    """Exclusive running sum of ``value`` per ``by`` in the order (``chunk``, ``order``).

    Two levels, so that a hot key is never sorted by one task: sums per chunk,
    a running sum over the (few) chunk totals, then a running sum inside each
    chunk.  ``chunk`` must be monotone in the order wanted.
    """
    keyed = df.withColumn("_chunk", chunk)
    totals = keyed.groupBy(*by, "_chunk").agg(F.sum(value).alias("_total"))
    over = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    keys = [*by, "_chunk"]
    totals = totals.select(*[F.col(k).alias(f"_t{i}") for i, k in enumerate(keys)],
                           F.coalesce(F.sum("_total").over(over), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    cond = [F.col(k).eqNullSafe(F.col(f"_t{i}")) for i, k in enumerate(keys)]
    joined = keyed.join(totals, cond, "left").drop(*[f"_t{i}" for i in range(len(keys))])
    return (joined.withColumn(name, F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
            .drop("_chunk", "_base"))


def revived(kind: type, fields: dict):
    """An object of ``kind`` with the attributes ``fields``.

    Broadcasts are pickled by reference to a class's module, which workers need
    not have: ``vars(object)`` is shipped instead, and the class travels with the
    function that revives it.
    """
    made = kind.__new__(kind)
    made.__dict__.update(fields)
    return made
