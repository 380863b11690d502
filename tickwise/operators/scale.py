"""Min-max scaling without look-ahead (M1-M6).

Fitted state is a small stats frame, one row per group (ticker): its size
is the number of groups times two doubles per feature, never the data
volume; it is joined back by an equi-join on the group key (a constant key
when there is no group), so there is no cross join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import keys_or_const


def fit_minmax(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ("ticker",),
               where: Column | None = None) -> DataFrame:
    """M1/M3: per-group min and max of each feature (nulls skipped).

    ``where`` restricts the fit to training rows (M3); the transform is then
    applied to all rows.
    """
    src = df if where is None else df.filter(where)
    aggs = []
    for c in cols:
        aggs += [F.min(c).cast("double").alias(f"{c}__min"), F.max(c).cast("double").alias(f"{c}__max")]
    if by:
        return src.groupBy(*by).agg(*aggs)
    return src.agg(*aggs)


def _range(c: str) -> Column:
    rng = F.col(f"{c}__max") - F.col(f"{c}__min")
    return F.when(rng == 0, F.lit(1.0)).otherwise(rng)


def _join_stats(df: DataFrame, stats: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    left, keys = keys_or_const(df, by)
    right, _ = keys_or_const(stats, by)
    return left.join(F.broadcast(right) if not by else right, on=keys, how="left"), keys


def apply_minmax(df: DataFrame, stats: DataFrame, cols: Sequence[str], by: Sequence[str] = ("ticker",),
                 suffix: str = "") -> DataFrame:
    """M2: (x - min) / (max - min), not clipped; a constant feature has range 1 -> x - min.

    Not ``ml.feature.MinMaxScaler``: that maps constant features to 0.5.
    Nulls stay null.
    """
    joined, keys = _join_stats(df, stats, by)
    scaled = [((F.col(c) - F.col(f"{c}__min")) / _range(c)).alias(c + suffix) for c in cols]
    keep = [F.col(c) for c in df.columns if suffix or c not in cols]
    return joined.select(*keep, *scaled)


def inverse_minmax(df: DataFrame, stats: DataFrame, col: str, stat_col: str | None = None,
                   by: Sequence[str] = ("ticker",), out: str | None = None) -> DataFrame:
    """M4/M5: x * (max - min) + min with the fitted stats of ``stat_col`` (default ``col``).

    Works on a double column or on an array of doubles (predictions per horizon).
    """
    sc = stat_col or col
    joined, keys = _join_stats(df, stats.select(*by, f"{sc}__min", f"{sc}__max") if by else
                               stats.select(f"{sc}__min", f"{sc}__max"), by)
    rng, lo = _range(sc), F.col(f"{sc}__min")
    dtype = dict(df.dtypes)[col]
    if dtype.startswith("array"):
        expr = F.transform(F.col(col), lambda x: x * rng + lo)
    else:
        expr = F.col(col) * rng + lo
    return joined.select(*[F.col(c) for c in df.columns if c != (out or col)], expr.alias(out or col))


def clip01(c: Column) -> Column:
    """M6: clip to [0, 1] (scaled predictions before the inverse)."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def minmax_scale(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ("ticker",),
                 where: Column | None = None, suffix: str = "") -> DataFrame:
    """M1+M2 (M3 with ``where``) in one pass: per-group min/max as unbounded windows.

    The frames this is applied to are already hash-partitioned by the group key
    (the alignment window ran on it), so the stats need no exchange and no join
    back; ``<c>__min``/``<c>__max`` stay on every row for the inverse transform.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*by)
    stats = {}
    for c in cols:
        src = F.col(c) if where is None else F.when(where, F.col(c))
        stats[f"{c}__min"] = F.min(src).over(w).cast("double")
        stats[f"{c}__max"] = F.max(src).over(w).cast("double")
    out = df.withColumns(stats)
    return out.withColumns({c + suffix: (F.col(c) - F.col(f"{c}__min")) / _range(c) for c in cols})


def inverse_with(c: Column, stat_col: str) -> Column:
    """M4 using the stats columns carried on the row (see ``minmax_scale``)."""
    return c * _range(stat_col) + F.col(f"{stat_col}__min")
