"""CSV sources and sinks with explicit schemas.

The reference's files are UTF-8 CSVs with a BOM and a header; Spark's CSV
reader strips the BOM.  Schemas are explicit (no inference pass over the
data).  Writers default to CSV to match the reference's artefacts; Parquet
is the better format on a cluster and is available through ``fmt``.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

BARS_SCHEMA = T.StructType([
    T.StructField("Date", T.DateType()),
    T.StructField("Ticker", T.StringType()),
    T.StructField("Adj Close", T.DoubleType()),
    T.StructField("Close", T.DoubleType()),
    T.StructField("High", T.DoubleType()),
    T.StructField("Low", T.DoubleType()),
    T.StructField("Open", T.DoubleType()),
    T.StructField("Volume", T.LongType()),
])
DAILY_FEATURES_SCHEMA = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("net_impact", T.DoubleType()),
    T.StructField("weighted_horizon", T.DoubleType()),
    T.StructField("news_count", T.DoubleType()),
    T.StructField("divergence", T.DoubleType()),
])
NEWS_SCHEMA = T.StructType([
    T.StructField("stock_id", T.StringType()),   # leading zeros survive
    T.StructField("date", T.StringType()),       # 'yyyy-MM-dd HH:mm'
    T.StructField("title", T.StringType()),
    T.StructField("source", T.StringType()),
])
ARTICLES_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in
                                ("title", "text", "publish_date", "source", "url")])
SCORES_SCHEMA = T.StructType([
    T.StructField("sentiment_score", T.DoubleType()),
    T.StructField("impact_intensity", T.DoubleType()),
    T.StructField("certainty", T.DoubleType()),
    T.StructField("time_horizon", T.DoubleType()),
    T.StructField("summary", T.StringType()),
    T.StructField("evidence", T.StringType()),
    T.StructField("reason", T.StringType()),
])
FORECAST_SCHEMA = T.StructType([
    T.StructField("Date", T.DateType()),
    T.StructField("Predicted_Price", T.DoubleType()),
])


def _csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
            .option("escape", '"').option("mode", "PERMISSIVE").csv(path))


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Long bars CSV, Date parsed, keyed by (Ticker, Date)."""
    return _csv(spark, path, BARS_SCHEMA)


def read_daily_features(spark: SparkSession, path: str) -> DataFrame:
    """Daily-features CSV."""
    return _csv(spark, path, DAILY_FEATURES_SCHEMA)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """S3: index series; only Date and Close are kept."""
    return read_bars(spark, path).select("Date", "Close")


def read_news(spark: SparkSession, path: str, schema: T.StructType = NEWS_SCHEMA) -> DataFrame:
    """News CSV with the stock key forced to string."""
    return _csv(spark, path, schema)


def read_forecast(spark: SparkSession, path: str) -> DataFrame:
    """Forecast CSV (Date, Predicted_Price)."""
    return _csv(spark, path, FORECAST_SCHEMA)


BOM = "\ufeff"


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite",
                partition_by: list[str] | None = None, bom: bool = True) -> None:
    """Full write with header; one folder of part files (no driver-side gather).

    Each CSV part begins with a byte order mark (it leads the header's first
    name), so that spreadsheets read the text as UTF-8; ``bom=False`` writes none.
    """
    if fmt == "csv" and bom:
        first = next(c for c in df.columns if c not in (partition_by or []))
        df = df.withColumnRenamed(first, BOM + first)
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", True).option("escape", '"')
    w.format(fmt).save(path)


def read_if_exists(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame | None:
    """The table under ``path``, or None if nothing was written there yet; other errors rise."""
    try:
        return spark.read.schema(schema).format(fmt).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def append_table(df: DataFrame, path: str, partition_by: list[str], key: list[str], fmt: str = "parquet") -> None:
    """Idempotent append: rows whose ``key`` the touched partitions do not hold yet are added.

    A re-run of a delivery adds nothing; a later delivery for the same
    partition keeps the earlier rows.  Null keys are compared as values.  Of the
    old table only the keys of the partition values that the delivery holds are
    read (a filter on the folders); the driver sees those values, never rows.
    """
    names = list(dict.fromkeys([*partition_by, *key]))
    new = df.dropDuplicates(names)
    old = read_if_exists(df.sparkSession, path, df.schema, fmt)
    if old is not None:
        old = touched(old, df, partition_by)
        old = old.select(*[F.col(c).alias(f"_old_{c}") for c in names])
        new = new.join(old, [F.col(c).eqNullSafe(F.col(f"_old_{c}")) for c in names], "left_anti")
    # rows of a partition value come together, large values are split over several writers
    new.hint("rebalance", *partition_by).write.mode("append").partitionBy(*partition_by).format(fmt).save(path)


def touched(old: DataFrame, new: DataFrame, partition_by: list[str]) -> DataFrame:
    """The rows of ``old`` in partitions whose values occur in ``new``, by a filter that prunes folders."""
    sets = [F.collect_set(c).alias(f"v{i}") for i, c in enumerate(partition_by)]
    nulls = [F.coalesce(F.bool_or(F.col(c).isNull()), F.lit(False)).alias(f"n{i}") for i, c in enumerate(partition_by)]
    seen = new.agg(*sets, *nulls).first()
    for i, c in enumerate(partition_by):
        held = F.col(c).isin(seen[f"v{i}"]) if seen[f"v{i}"] else F.lit(False)
        old = old.filter(held | F.col(c).isNull() if seen[f"n{i}"] else held)
    return old


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory (never machine-local on a cluster)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tickwise-io/{name}-{uuid.uuid4().hex[:12]}"


def bars_to_csv_layout(df: DataFrame) -> DataFrame:
    """Rename the engine's bar columns to the reference's CSV layout."""
    return df.select(
        F.col("date").alias("Date"), F.col("ticker").alias("Ticker"), F.col("adj_close").alias("Adj Close"),
        F.col("close").alias("Close"), F.col("high").alias("High"), F.col("low").alias("Low"),
        F.col("open").alias("Open"), F.col("volume").cast("bigint").alias("Volume"),
    )
