"""Daily news features from scored articles.

The reference ships only the output of this step; the semantics follow the
survey's reconstruction:

* news_count       rows per calendar day (double)
* net_impact       sum_k 0.5**k * x_k, x = sentiment*intensity*certainty,
                   k = rank in the day by |x| descending, id ascending
* weighted_horizon sum(horizon*w) / sum(w), 0 when sum(w) = 0 (w = intensity)
* divergence       sample std-dev of sentiment, 0 for a one-row day

Skew: a single day may hold a large share of all rows.  Count, sums and
std-dev are partial aggregates (map-side combine).  The rank of
``net_impact`` is the only order-dependent part, and it is exact to keep only
the first 1075 ranks of a day: ``0.5**k`` is exactly 0.0 in double precision
for k >= 1075, so lower-ranked rows add exactly nothing.  That top-k runs in
levels: per (day, hash salt) over ``salt_buckets`` groups, then over groups
``fan_in`` times coarser, down to one group per day, each level keeping at
most 1075 rows per group (see ``net_impact``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# 0.5**k underflows to exactly 0.0 (below the smallest subnormal 2**-1074) for k >= 1075.
ZERO_WEIGHT_RANK = 1075


def impact(sentiment: Column, intensity: Column, certainty: Column) -> Column:
    return sentiment * intensity * certainty


def net_impact(df: DataFrame, day: str = "day", id_col: str = "id", x: str = "x",
               salt_buckets: int = 4096, fan_in: int = 64) -> DataFrame:
    """F2: (day, net_impact) = sum of 0.5**rank * x, rank by |x| desc then id.

    Exact multi-level top-k: rows get a hash salt in [0, salt_buckets); each
    level keeps the first 1075 rows per (day, salt mod b) and divides b by
    ``fan_in`` until b = 1, so no group ever holds more than
    max(rows / salt_buckets, fan_in * 1075) rows, however hot a day is.
    """
    rows = df.select(day, id_col, x).filter(F.col(x).isNotNull())
    order = [F.abs(F.col(x)).desc(), F.col(id_col).asc()]
    cur = rows.withColumn("_salt", F.pmod(F.xxhash64(F.col(id_col)), F.lit(salt_buckets)))
    b = salt_buckets
    while b > 1:
        w = Window.partitionBy(day, F.pmod(F.col("_salt"), F.lit(b))).orderBy(*order)
        cur = cur.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= ZERO_WEIGHT_RANK).drop("_r")
        b = max(1, b // fan_in)
    w2 = Window.partitionBy(day).orderBy(*order)
    ranked = cur.withColumn("_k", F.row_number().over(w2) - 1).filter(F.col("_k") < ZERO_WEIGHT_RANK)
    return ranked.groupBy(day).agg(
        F.sum(F.col(x) * F.pow(F.lit(0.5), F.col("_k"))).alias("net_impact")
    )


def daily_features(scored: DataFrame, day: str = "day", id_col: str = "id", sentiment: str = "sentiment",
                   intensity: str = "intensity", certainty: str = "certainty", horizon: str = "horizon",
                   weight: str | None = None, null_policy: str = "skip", salt_buckets: int = 4096,
                   fan_in: int = 64) -> DataFrame:
    """One row per calendar day with news (days without news are absent).

    ``weight`` is the weight column of ``weighted_horizon`` (default intensity).
    ``null_policy='propagate'`` makes net_impact null when any x of the day is null;
    'both' does so and adds the value of 'skip' as ``net_impact_skip``.
    """
    w = weight or intensity
    base = scored.select(
        F.col(day).alias("day"), F.col(id_col).alias("id"),
        F.col(sentiment).cast("double").alias("s"), F.col(horizon).cast("double").alias("h"),
        F.col(w).cast("double").alias("w"),
        impact(F.col(sentiment), F.col(intensity), F.col(certainty)).cast("double").alias("x"),
    )
    wsum = F.sum(F.when(F.col("h").isNotNull(), F.col("w")))
    agg = base.groupBy("day").agg(
        F.count(F.lit(1)).cast("double").alias("news_count"),
        F.sum(F.col("h") * F.col("w")).alias("_hw"),
        wsum.alias("_w"),
        F.stddev_samp("s").alias("_sd"),
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("x").isNull()).alias("_xnull"),
    )
    net = net_impact(base, "day", "id", "x", salt_buckets, fan_in)
    out = agg.join(net, on="day", how="left")
    net_col = F.col("net_impact")
    more = [net_col.alias("net_impact_skip")] if null_policy == "both" else []
    if null_policy in ("propagate", "both"):
        net_col = F.when(F.col("_xnull") > 0, F.lit(None).cast("double")).otherwise(net_col)
    elif null_policy != "skip":
        raise ValueError(null_policy)
    return out.select(
        F.col("day").alias(day),
        net_col.alias("net_impact"),
        F.when(F.coalesce(F.col("_w"), F.lit(0.0)) == 0, F.lit(0.0)).otherwise(F.col("_hw") / F.col("_w")).alias("weighted_horizon"),
        "news_count",
        F.when(F.col("_n") == 1, F.lit(0.0)).otherwise(F.col("_sd")).alias("divergence"),
        *more,
    )


def feature_anomalies(feats: DataFrame) -> DataFrame:
    """flags for out-of-contract daily features."""
    return feats.withColumns({
        "horizon_out_of_range": ~F.col("weighted_horizon").between(0.0, 0.8),
        "divergence_too_high": F.col("divergence") > F.sqrt(F.lit(2.0)),
        "net_impact_too_large": F.abs(F.col("net_impact")) >= 2.0,
    })
