"""Shaping operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def wide_to_long(df: DataFrame, id_cols: Sequence[str] = ("date",), sep: str = "|",
                 ticker_col: str = "ticker") -> DataFrame:
    """Columns ``<field><sep><ticker>`` -> one row per (id, ticker), one column per field.

    Rows whose fields are all null are kept (the reference's ``future_stack``).
    The field/ticker grid comes from the schema, so this is a narrow per-row
    ``explode`` — no shuffle, unlike a ``groupBy().pivot()``.
    """
    grid: dict[str, dict[str, str]] = {}
    fields: list[str] = []
    for c in df.columns:
        if c in id_cols or sep not in c:
            continue
        f, t = c.split(sep, 1)
        grid.setdefault(t, {})[f] = c
        if f not in fields:
            fields.append(f)
    per_ticker = [
        F.struct(F.lit(t).alias(ticker_col),
                 *[(F.col(f"`{cols[f]}`") if f in cols else F.lit(None)).alias(f) for f in fields])
        for t, cols in grid.items()
    ]
    return df.select(*id_cols, F.explode(F.array(*per_ticker)).alias("_r")).select(*id_cols, "_r.*")


def sort_bars(df: DataFrame, keys: Sequence[str] = ("ticker", "date")) -> DataFrame:
    """Total order by (ticker, date): range partitioning + local sort (no single-task sort)."""
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def date_spine(spark: SparkSession, start: Column | str, end: Column | str) -> DataFrame:
    """One row per day, both ends included (a calendar-sized frame)."""
    s = F.lit(start).cast("date") if isinstance(start, str) else start
    e = F.lit(end).cast("date") if isinstance(end, str) else end
    return spark.range(1).select(F.explode(F.sequence(s, e)).alias("date"))


def spine_between(df: DataFrame, col: str = "date") -> DataFrame:
    """S11 over data: the spine from the min to the max date of ``df``."""
    return df.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi")).select(
        F.explode(F.sequence("_lo", "_hi")).alias("date"))


def minute_text(c: Column) -> Column:
    """Timestamp (or timestamp text) -> 'yyyy-MM-dd HH:mm'."""
    return F.date_format(F.coalesce(F.try_to_timestamp(c.cast("string")), c.cast("timestamp")), "yyyy-MM-dd HH:mm")


def day_slice(df: DataFrame, spine: DataFrame, date_text: str = "date") -> DataFrame:
    """Keep rows whose date text starts with one of the requested days.

    At scale the per-day prefix test is an equi-join on the 10-character day key
    with the (calendar-sized, broadcast) spine.
    """
    keys = F.broadcast(spine.select(F.date_format("date", "yyyy-MM-dd").alias("_day")))
    return df.join(keys, F.substring(F.col(date_text), 1, 10) == F.col("_day"), "left_semi")


def day_range(df: DataFrame, ts_col: str, start: str, end: str) -> DataFrame:
    """S12 for a literal day range: ``start <= ts < end + 1 day`` on the raw timestamp,
    a predicate the parquet scan can push down (row groups outside are skipped)."""
    lo = F.lit(start).cast("date")
    hi = F.date_add(F.lit(end).cast("date"), 1)
    c = F.col(ts_col)
    return df.filter((c >= lo.cast(df.schema[ts_col].dataType)) & (c < hi.cast(df.schema[ts_col].dataType)))


def cast_key(df: DataFrame, col: str = "stock_id") -> DataFrame:
    """Key to string (leading zeros are kept when it is already text)."""
    return df.withColumn(col, F.col(col).cast("string"))


def drop_cols(df: DataFrame, *cols: str) -> DataFrame:
    """Drop columns if present."""
    return df.drop(*cols)


def resolve_date_col(df: DataFrame, out: str = "ts") -> DataFrame:
    """Use ``date`` if present, else ``publish_date``; parsed to a timestamp (NULL if unparsable)."""
    src = "date" if "date" in df.columns else "publish_date"
    return df.withColumn(out, F.try_to_timestamp(F.col(src).cast("string")))


ARTICLE_COLUMNS = ["title", "text", "publish_date", "source", "url"]


def articles_schema_select(df: DataFrame, cols: Sequence[str] = ARTICLE_COLUMNS) -> DataFrame:
    """Fixed column set (missing columns as null strings), also for an empty input."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None).cast(T.StringType())).alias(c) for c in cols])


def load_counts(df: DataFrame, day: str = "date") -> DataFrame:
    """Rows per day plus a grand total (day NULL) via rollup."""
    return df.rollup(day).agg(F.count(F.lit(1)).alias("n"))


def profile(df: DataFrame) -> DataFrame:
    """One row per column: type, rows, nulls, min and max (numeric columns as double).

    A single aggregate pass over all columns, unpivoted afterwards.
    """
    aggs = [F.count(F.lit(1)).alias("_rows")]
    numeric = {}
    for name, dtype in df.dtypes:
        aggs.append(F.count_if(F.col(f"`{name}`").isNull()).alias(f"{name}__nulls"))
        is_num = dtype in ("double", "float", "int", "bigint", "smallint", "tinyint") or dtype.startswith("decimal")
        numeric[name] = is_num
        if is_num:
            aggs += [F.min(F.col(f"`{name}`")).cast("double").alias(f"{name}__min"),
                     F.max(F.col(f"`{name}`")).cast("double").alias(f"{name}__max")]
    one = df.agg(*aggs)
    rows = [
        F.struct(F.lit(name).alias("column"), F.lit(dtype).alias("dtype"), F.col("_rows").alias("n_rows"),
                 F.col(f"`{name}__nulls`").cast("bigint").alias("n_null"),
                 (F.col(f"`{name}__min`") if numeric[name] else F.lit(None).cast("double")).alias("min_value"),
                 (F.col(f"`{name}__max`") if numeric[name] else F.lit(None).cast("double")).alias("max_value"))
        for name, dtype in df.dtypes
    ]
    return one.select(F.explode(F.array(*rows)).alias("_p")).select("_p.*")


def preview(df: DataFrame, order: Sequence[str], n: int = 3, k: int = 200, text_cols: Sequence[str] = ("text",)) -> DataFrame:
    """First ``n`` rows by an explicit ordinal, text cut to ``k`` characters (top-n is the feature)."""
    out = df.orderBy(*order).limit(n)
    for c in text_cols:
        out = out.withColumn(c, F.substring(F.col(c), 1, k))
    return out


def project(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Feature projection in a fixed order."""
    return df.select(*[F.col(c) for c in features])
