"""Supervised window datasets.

A sample is one row: the ``n`` steps ending at position ``pos`` and the
``h`` values after it.  Windows are row frames partitioned by ticker, so a
task holds one ticker's trading days (bounded by the calendar); all windows
on the aligned table share one exchange and one sort.  ``collect_list``
skips nulls, so every step is wrapped in a struct and unwrapped afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def windows(df: DataFrame, feats: Sequence[str], n: int, h: int = 1, target: str = "close",
            by: Sequence[str] = ("ticker",), order: str = "date", keep: Sequence[str] = ()) -> DataFrame:
    """X = ``n`` consecutive rows of ``feats``; y = next ``h`` values of ``target``.

    Returns (by…, pos, end_date, x: array<array<double>>, y: array<double>),
    N - n - h + 1 samples per key.  ``pos`` is the position of the last input row;
    ``keep`` columns of that row are carried along.
    """
    w = Window.partitionBy(*by).orderBy(order)
    past = w.rowsBetween(-(n - 1), 0)
    ahead = w.rowsBetween(1, h)
    step = F.struct(F.array(*[F.col(c).cast("double") for c in feats]).alias("v"))
    return (
        df.withColumn("pos", F.row_number().over(w) - 1)
        .withColumn("_x", F.collect_list(step).over(past))
        .withColumn("_y", F.collect_list(F.struct(F.col(target).cast("double").alias("v"))).over(ahead))
        .filter((F.size("_x") == n) & (F.size("_y") == h))
        .select(*by, "pos", F.col(order).alias("end_date"), *keep,
                F.transform("_x", lambda s: s["v"]).alias("x"),
                F.transform("_y", lambda s: s["v"]).alias("y"))
    )


def windows_multi(df: DataFrame, groups: dict[str, Sequence[str]], n: int, h: int, target: str = "close",
                  by: Sequence[str] = ("ticker",), order: str = "date") -> DataFrame:
    """One window column per input group (e.g. bars, index, news) on the aligned table."""
    w = Window.partitionBy(*by).orderBy(order)
    step = F.struct(*[F.array(*[F.col(c).cast("double") for c in cols]).alias(g) for g, cols in groups.items()])
    return (
        df.withColumn("pos", F.row_number().over(w) - 1)
        .withColumn("_x", F.collect_list(step).over(w.rowsBetween(-(n - 1), 0)))
        .withColumn("_y", F.collect_list(F.struct(F.col(target).cast("double").alias("v"))).over(w.rowsBetween(1, h)))
        .filter((F.size("_x") == n) & (F.size("_y") == h))
        .select(*by, "pos", F.col(order).alias("end_date"),
                *[F.transform("_x", lambda s: s[g]).alias(g) for g in groups],
                F.transform("_y", lambda s: s["v"]).alias("y"))
    )


def concat_features(df: DataFrame, groups: Sequence[str], out: str = "x") -> DataFrame:
    """Per step, concatenate the feature axes of several window columns in order
    (bars 6, index 1, news 4 -> 11 per step)."""
    acc = F.col(groups[0])
    for g in groups[1:]:
        acc = F.zip_with(acc, F.col(g), lambda a, b: F.concat(a, b))
    return df.withColumn(out, acc)


def concat_windows(df: DataFrame, groups: dict[str, Sequence[str]], n: int, h: int, target: str = "close",
                   by: Sequence[str] = ("ticker",), order: str = "date") -> DataFrame:
    """W4 from the aligned table: every step is collected with the groups' columns already in
    order, so there is one window array and nothing to zip; equal to ``concat_features`` of
    ``windows_multi``."""
    return windows(df, [c for cols in groups.values() for c in cols], n, h, target, by, order)


def _split_label(pos, n, train: float, val: float, gap: int = 0):
    t_end = F.floor(n * F.lit(float(train)))
    v_end = F.floor(n * F.lit(float(val)))
    return (
        F.when(pos < t_end - gap, F.lit("train"))
        .when(pos < t_end, F.lit(None))
        .when(pos < v_end, F.lit("val"))
        .otherwise(F.lit("test"))
    )


def split_rows(df: DataFrame, train: float = 0.7, val: float = 0.85, by: Sequence[str] = ("ticker",),
               order: str = "date") -> DataFrame:
    """Chronological 70/15/15 split of rows: int(N*0.7), int(N*0.85) per key."""
    w = Window.partitionBy(*by).orderBy(order)
    return (
        df.withColumn("pos", F.row_number().over(w) - 1)
        .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
        .withColumn("split", _split_label(F.col("pos"), F.col("_n"), train, val))
        .drop("_n")
    )


def split_samples(df: DataFrame, train: float = 0.7, val: float = 0.85, gap: int = 0,
                  by: Sequence[str] = ("ticker",), order: str = "pos") -> DataFrame:
    """The same split on the sample sequence; ``gap`` samples before the
    boundary are left out (label null) to stop overlapping windows leaking."""
    w = Window.partitionBy(*by).orderBy(order)
    return (
        df.withColumn("spos", F.row_number().over(w) - 1)
        .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
        .withColumn("split", _split_label(F.col("spos"), F.col("_n"), train, val, gap))
        .drop("_n")
    )


def tail_split(df: DataFrame, frac: float = 0.3, by: Sequence[str] = ("ticker",), order: str = "pos") -> DataFrame:
    """Last ``frac`` of the samples for validation: split at int(N * (1 - frac))."""
    w = Window.partitionBy(*by).orderBy(order)
    return (
        df.withColumn("_p", F.row_number().over(w) - 1)
        .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
        .withColumn("split", F.when(F.col("_p") < F.floor(F.col("_n") * F.lit(1.0 - frac)), F.lit("train"))
                    .otherwise(F.lit("val")))
        .drop("_p", "_n")
    )


def flatten_window(df: DataFrame, col: str = "x", out: str = "features", as_vector: bool = True) -> DataFrame:
    """Flatten a window (array of steps) to one vector, step-major."""
    flat = F.flatten(F.col(col))
    if as_vector:
        from pyspark.ml.functions import array_to_vector

        flat = array_to_vector(flat)
    return df.withColumn(out, flat)
