"""Small shared helpers for operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import scratch_path


def one_per_day(df: DataFrame, key: str = "date") -> DataFrame:
    """``df`` checked to hold one row per day: a day with more raises an error when the plan runs.

    A frame that was just aggregated by ``key`` keeps its partitioning, so the
    check adds no exchange.
    """
    others = [c for c in df.columns if c != key]
    days = df.groupBy(key).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in others])
    day = F.when(F.col("_n") == 1, F.col(key)).otherwise(F.raise_error(F.lit("more than one row of a day in a per-day table")))
    return days.select(day.alias(key), *others)


def calendar_broadcast(df: DataFrame, key: str = "date") -> DataFrame:
    """A per-day table, checked by ``one_per_day`` and marked for broadcast: it has no
    more rows than the calendar has days (36,525 a century), whatever the data volume."""
    return F.broadcast(one_per_day(df, key))


def ordered_window(by: Sequence[str], order: Sequence[Column | str]):
    return Window.partitionBy(*by).orderBy(*order)


def keys_or_const(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Join keys; an empty key list becomes a constant key (a one-group stats frame
    is joined by an equi-join on it, never by a cross join)."""
    if by:
        return df, list(by)
    return df.withColumn("_all", F.lit(0)), ["_all"]


def distributed_rank(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str = "_rn", tie: str | None = None) -> DataFrame:
    """``row_number`` of every row inside its ``by`` group in ``order``, with no group ranked by one task.

    First pass: rows are dealt into ranges of (by, order), a group of any size over
    as many ranges as its rows fill, sorted and numbered inside their range, and
    written to the shared folder (the ranges are then fixed).  Second pass: the
    rows of every (range, group) are counted, running sums of those few counts
    give each range's offset, and rank = place in the range + offset.  Rows that
    are equal in ``order`` are told apart by a hash of the whole row, so many
    equal keys are dealt over ranges too; their order is then the hash's.  ``tie`` names
    a column to take for that hash and to leave out of the result, for a frame
    whose other columns need not be carried along.
    Null group values are a group; column names beginning with ``_dr_`` are reserved.
    """
    spark = df.sparkSession
    hashed = F.xxhash64(*[F.col(c) for c in df.columns]) if tie is None else F.col(tie)
    keys = [*[F.col(c) for c in by], *[F.col(c) for c in order], F.col("_dr_tie")]
    df = df.withColumn("_dr_tie", hashed).drop(*([tie] if tie else []))
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = ranged.withColumns({"_dr_range": F.spark_partition_id(), "_dr_at": F.monotonically_increasing_id()}).drop("_dr_tie")
    path = scratch_path(spark, "ranked")
    ranged.write.parquet(path)
    rows = spark.read.schema(ranged.schema).parquet(path)
    counts = rows.groupBy("_dr_range", *by).agg(F.count(F.lit(1)).alias("_dr_n"), F.min("_dr_at").alias("_dr_first"))
    earlier = Window.partitionBy(*by).orderBy("_dr_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("_dr_range").alias("_dr_r"), *[F.col(c).alias(f"_dr_b{i}") for i, c in enumerate(by)],
                           (F.coalesce(F.sum("_dr_n").over(earlier), F.lit(0)) - F.col("_dr_first")).alias("_dr_offset"))
    same = [F.col("_dr_range") == F.col("_dr_r"), *[F.col(c).eqNullSafe(F.col(f"_dr_b{i}")) for i, c in enumerate(by)]]
    found = rows.join(counts, same)
    return found.select(*[c for c in df.columns if c != "_dr_tie"], (F.col("_dr_at") + F.col("_dr_offset") + 1).alias(out))
