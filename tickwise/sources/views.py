"""Test views over the driver tables (FIXTURES.md part B).

Each view maps a generic table onto the shape the workflow consumes:
price bars, an index series, scored news, news items, pages and raw scorer
responses.  The same definitions exist as DuckDB SQL in
``tickwise.plans.sql_views`` so that every query has an independent oracle.

Scale notes: ``bars`` is one hash aggregate with map-side partial
aggregation (``min_by``/``max_by`` are partial-aggregatable), so its shuffle
carries one row per (ticker, day, map task), not per line item.  The
daily views are bounded by the calendar: one row per day (and ticker).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

# Fixed values of the test views (FIXTURES.md): tie order of line items,
# the shift that moves January 2024 into the bar calendar, the news epoch.
BAR_TIE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
FEATURE_SHIFT_MONTHS = -324  # 2024-01 -> 1997-01, inside the 1995-2001 bars
NEWS_EPOCH = "1998-01-01"
NEWS_DAYS = 40
NEWS_STOCKS = 7


def _exact_mean(col: str):
    """Mean of a 2-decimal money/rate column, independent of summation order.

    A double sum depends on the order partial sums are combined in (a
    shuffle's fetch order); summing as DECIMAL is exact, so every run — and the
    SQL oracle — gets the same double.
    """
    total = F.sum(F.col(col).cast("decimal(18,2)")).cast("double")
    return total / F.count(F.col(col))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V_bars: ticker, date, open, high, low, close, adj_close, volume."""
    li = table(spark, sf_dir, "lineitem")
    price = F.try_divide(F.col("l_extendedprice"), F.col("l_quantity"))
    order = F.struct(*[F.col(c) for c in BAR_TIE_ORDER])
    daily = li.groupBy(
        F.col("l_returnflag").alias("ticker"),
        F.col("l_shipdate").cast("date").alias("date"),
    ).agg(
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
        _exact_mean("l_discount").alias("_disc"),
        F.sum("l_quantity").cast("bigint").alias("volume"),
    )
    return daily.select(
        "ticker", "date", "open", "high", "low", "close",
        (F.col("close") * (F.lit(1.0) - F.col("_disc"))).alias("adj_close"),
        "volume",
    )


def index_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V_index: date, close = mean order price of the day."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(
        _exact_mean("o_totalprice").alias("close")
    )


def wide_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V_wide: one row per date, columns ``<field>|<ticker>`` (a wide download)."""
    b = bars(spark, sf_dir)
    fields = ["open", "high", "low", "close", "adj_close", "volume"]
    tickers = ["A", "N", "R"]
    p = b.groupBy("date").pivot("ticker", tickers).agg(
        *[F.first(c).alias(c) for c in fields]
    )
    return p.select(
        "date",
        *[F.col(f"{t}_{c}").cast("double").alias(f"{c}|{t}") for c in fields for t in tickers],
    )


def _k(props):
    return F.get_json_object(props, "$.k").try_cast("int")


def horizon_of(event_type):
    return (
        F.when(event_type.isin("purchase", "signup"), F.lit(0.8))
        .when(event_type == "click", F.lit(0.4))
        .otherwise(F.lit(0.1))
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V_scored: id, day, sentiment, intensity, certainty, horizon (doubles from integers)."""
    e = table(spark, sf_dir, "events")
    k = _k(F.col("props"))
    return e.select(
        F.col("event_id").alias("id"),
        F.col("ts").cast("date").alias("day"),
        ((k % 21 - 10).cast("double") / 10.0).alias("sentiment"),
        ((F.col("event_id") % 11).cast("double") / 10.0).alias("intensity"),
        ((F.floor("value") % 11).cast("double") / 10.0).alias("certainty"),
        horizon_of(F.col("event_type")).alias("horizon"),
    )


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V_news: id, stock_id, date, title, text, source."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"),
        F.lpad((F.col("doc_id") % NEWS_STOCKS).cast("string"), 4, "0").alias("stock_id"),
        F.date_add(F.lit(NEWS_EPOCH).cast("date"), (F.col("doc_id") % NEWS_DAYS).cast("int")).alias("date"),
        F.substring_index(F.col("text"), "\n", 1).alias("title"),
        F.col("text"),
        F.col("source"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V_pages: page_id, url, html as stored."""
    return table(spark, sf_dir, "pages").select("page_id", "url", "html")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V_response: id, response — raw scorer answers derived from ``events``.

    Cases by id: a third fenced as ```json … ```, some cut short (malformed),
    some ``{}``, some a JSON list; certainty is sent as a JSON string and
    sentiment spans [-1.5, 1.5] so that range checks have work.
    """
    e = table(spark, sf_dir, "events")
    k = _k(F.col("props"))
    eid = F.col("event_id")
    h = (
        F.when(F.col("event_type").isin("purchase", "signup"), F.lit("0.8"))
        .when(F.col("event_type") == "click", F.lit("0.4"))
        .otherwise(F.lit("0.1"))
    )
    obj = F.concat(
        F.lit('{"sentiment_score": '), (k % 31 - 15).cast("string"),
        F.lit('e-1, "impact_intensity": '), (eid % 11).cast("string"),
        F.lit('e-1, "certainty": "'), (F.floor("value") % 11).cast("string"),
        F.lit('e-1", "time_horizon": '), h,
        F.lit(', "summary": "'), F.col("event_type"),
        F.lit('", "evidence": "k='), k.cast("string"),
        F.lit('", "reason": "user '), F.col("user_id").cast("string"), F.lit('"}'),
    )
    body = (
        F.when(eid % 83 == 0, F.lit("{}"))
        .when(eid % 89 == 0, F.concat(F.lit("["), obj, F.lit("]")))
        .otherwise(obj)
    )
    cut = F.when(eid % 97 == 0, F.expr("substring(_b, 1, length(_b) - 5)")).otherwise(F.col("_b"))
    fenced = F.when(eid % 3 == 0, F.concat(F.lit("```json\n"), F.col("_r"), F.lit("\n```"))).otherwise(F.col("_r"))
    return (
        e.select(eid.alias("id"), body.alias("_b"), eid)
        .select("id", "event_id", cut.alias("_r"))
        .select("id", fenced.alias("response"))
    )


def feats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V_feats: daily features of V_scored, dates moved into the bar calendar."""
    from ..operators.features import daily_features

    f = daily_features(scored(spark, sf_dir))
    return f.select(F.add_months("day", FEATURE_SHIFT_MONTHS).alias("date"),
                    "net_impact", "weighted_horizon", "news_count", "divergence")
