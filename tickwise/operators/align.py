"""Calendar alignment.

Bars are keyed by (ticker, date); side tables (daily news features, an index
series) are keyed by date alone; they are checked to hold one row per calendar
day (a second one raises) and broadcast: the bars never shuffle for the join, and the only exchange is the
``partitionBy(ticker)`` of the following window, which every window of the
forecast workflow then reuses.  A ticker's partition holds one row per trading
day, so its size is bounded by the calendar, not by the data volume.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._util import calendar_broadcast, one_per_day


def _side(df: DataFrame, cols: Sequence[str], key: str, prefix: str) -> DataFrame:
    return df.select(F.col(key).alias("date"), *[F.col(c).alias(prefix + c) for c in cols])


def align_zero(bars: DataFrame, feats: DataFrame, cols: Sequence[str], key: str = "date",
               prefix: str = "") -> DataFrame:
    """Every bar row once, exact date match, missing (and null) features -> 0.

    Feature rows on non-trading days are dropped (left join from the bars).
    """
    side = calendar_broadcast(_side(feats, cols, key, prefix))
    out = bars.join(side, on="date", how="left")
    return out.select(
        *[F.col(c) for c in bars.columns],
        *[F.coalesce(F.col(prefix + c).cast("double"), F.lit(0.0)).alias(prefix + c) for c in cols],
    )


def align_ffill(bars: DataFrame, idx: DataFrame, col: str = "close", out: str = "idx_close",
                by: Sequence[str] = ("ticker",), key: str = "date") -> DataFrame:
    """Exact match, then forward fill from the last matched trading day.

    Leading gaps stay null; index values on dates off the bar calendar never
    carry forward (they are dropped by the left join before the fill).
    """
    side = calendar_broadcast(idx.select(F.col(key).alias("date"), F.col(col).alias(out)))
    w = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return bars.join(side, on="date", how="left").withColumn(out, F.last(out, ignorenulls=True).over(w))


def align_asof(bars: DataFrame, idx: DataFrame, col: str = "close", out: str = "idx_close",
               key: str = "date") -> DataFrame:
    """True as-of join: last index value on or before each bar date.

    Built on the calendar, not per ticker: the distinct bar dates and the index
    dates (both one row per day) are unioned and filled with one running
    ``last(ignorenulls)``; the result (one row per day) is broadcast back to the
    bars by an equi-join.  No inequality join.
    """
    cal = bars.select("date").distinct().withColumn("_v", F.lit(None).cast("double")).withColumn("_src", F.lit(1))
    ix = one_per_day(idx.select(F.col(key).alias("date"), F.col(col).cast("double").alias("_v"))).withColumn("_src", F.lit(0))
    # one window over a calendar-sized table (one row per day); ordered so that
    # an index value on the same day is seen before the bar date
    w = Window.orderBy("date", "_src").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = (
        cal.unionByName(ix)
        .withColumn(out, F.last("_v", ignorenulls=True).over(w))
        .filter(F.col("_src") == 1)
        .select("date", out)
    )
    return bars.join(F.broadcast(filled), on="date", how="left")  # one row per distinct date


def align_position(a: DataFrame, b: DataFrame, b_cols: Sequence[str], by: Sequence[str] = ("ticker",),
                   prefix: str = "b_") -> DataFrame:
    """T4: i-th row of ``a`` (per ticker, by date) with i-th row of ``b`` (by date).

    Dates of ``b`` are ignored, as in the reference's positional concatenation.
    ``b`` is a per-day series (checked); its positions come from one window over
    the calendar-sized table.
    """
    pa = a.withColumn("_pos", F.row_number().over(Window.partitionBy(*by).orderBy("date")))
    days = one_per_day(b.select("date", *[F.col(c).alias(prefix + c) for c in b_cols]))
    pb = days.select(F.row_number().over(Window.orderBy("date")).alias("_pos"), *[prefix + c for c in b_cols])
    return pa.join(F.broadcast(pb), on="_pos", how="left").drop("_pos")


def window_ranges(bars: DataFrame, step: int = 20, by: Sequence[str] = ("ticker",), h: int = 0) -> DataFrame:
    """(ticker, start_pos, start_date, end_date) of every window of ``step`` bars
    that is followed by at least ``h`` more bars (the samples that have targets)."""
    w = Window.partitionBy(*by).orderBy("date")
    return (
        bars.select(*by, "date")
        .withColumn("start_pos", F.row_number().over(w) - 1)
        .withColumn("end_date", F.lead("date", step - 1).over(w))
        .withColumn("_tail", F.lead("date", step - 1 + h).over(w))
        .filter(F.col("_tail").isNotNull())
        .select(*by, "start_pos", F.col("date").alias("start_date"), "end_date")
    )


def calendar_slices(feats: DataFrame, cols: Sequence[str], key: str = "date"):
    """A per-day table as (start, end) -> array of its rows with start <= date <= end, by date.

    The table becomes one sorted array, with for every calendar day between its
    first and last date the number of rows before that day: both have no more
    entries than the calendar has days, and are one scalar subquery of the plan.
    A range is then two look-ups and a slice.
    """
    side = one_per_day(feats.select(F.col(key).alias("date"), *[F.col(c).cast("double").alias(c) for c in cols]).filter(F.col("date").isNotNull()))
    rows = side.agg(F.array_sort(F.collect_list(F.struct("date", *cols))).alias("rows"))
    dates = F.transform("rows", lambda r: r["date"])
    steps = F.zip_with(dates, F.concat(F.slice(dates, 1, 1), F.slice(dates, 1, F.greatest(F.size("rows") - 1, F.lit(0)))), lambda d, e: F.date_diff(d, e))
    # the days after one date up to the next have the same number of rows before them
    before = F.flatten(F.transform(steps, lambda n, i: F.array_repeat(i, F.when(i == 0, 1).otherwise(n))))
    calendar = rows.select(F.struct(F.col("rows"), before.alias("before")).alias("c")).scalar()

    def between(start: Column, end: Column) -> Column:
        held, first = calendar["rows"], F.get(calendar["rows"], F.lit(0))["date"]
        n = F.size(held)

        def earlier(day: Column) -> Column:  # rows before a day
            at = F.date_diff(day, first)
            return F.when(at <= 0, 0).otherwise(F.coalesce(F.get(calendar["before"], at), n))

        lo, hi = earlier(start), earlier(F.date_add(end, 1))
        return F.when(n > 0, F.slice(held, lo + 1, F.greatest(hi - lo, F.lit(0)))).otherwise(held)

    return between


def window_news(bars: DataFrame, feats: DataFrame, cols: Sequence[str], step: int = 20,
                by: Sequence[str] = ("ticker",), key: str = "date", h: int = 0) -> DataFrame:
    """T5: news rows inside each bar window by calendar range [first, last] (weekends included).

    A window is a slice of the sorted per-day features (``calendar_slices``): no
    day is exploded, nothing is joined or regrouped.
    Returns (ticker, start_pos, start_date, end_date, news: array<struct<date, cols…>>).
    """
    between = calendar_slices(feats, cols, key)
    return window_ranges(bars, step, by, h).withColumn("news", between(F.col("start_date"), F.col("end_date")))


def pad_post(df: DataFrame, col: str, fields: Sequence[str], out: str = "padded") -> DataFrame:
    """Post-pad ragged arrays of structs with zeros to the longest, as float32 rows.

    The longest length is a scalar subquery of the plan; building it runs nothing.
    """
    longest = df.agg(F.coalesce(F.max(F.size(col)), F.lit(0)).alias("m")).scalar()
    as_rows = F.transform(F.col(col), lambda s: F.array(*[s[f].cast("float") for f in fields]))
    zero = F.array(*[F.lit(0.0).cast("float") for _ in fields])
    return df.withColumn(
        out, F.concat(as_rows, F.array_repeat(zero, longest - F.size(col)))
    ).withColumn("pad_len", longest)


def last_n(df: DataFrame, n: int, by: Sequence[str] = ("ticker",), order: str = "date") -> DataFrame:
    """Last ``n`` rows per key."""
    w = Window.partitionBy(*by).orderBy(F.col(order).desc())
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def backtest_slice(df: DataFrame, n: int, past: int, h: int, by: Sequence[str] = ("ticker",),
                   order: str = "date") -> DataFrame:
    """The ``n`` rows that end ``past`` rows before the end (role 'input') and the
    next ``h`` rows (role 'actual').  ``rpos`` 0 is the last row."""
    w = Window.partitionBy(*by).orderBy(F.col(order).desc())
    r = df.withColumn("rpos", F.row_number().over(w) - 1)
    role = (
        F.when(F.col("rpos").between(past, past + n - 1), F.lit("input"))
        .when(F.col("rpos").between(max(past - h, 0), past - 1), F.lit("actual"))
    )
    return r.withColumn("role", role).filter(F.col("role").isNotNull())


def future_bdays(last: Column, h: int) -> Column:
    """The next ``h`` Monday-Friday days after ``last`` (no holidays).

    Takes the first h+1 weekdays on or after ``last`` and drops the first, so
    from a weekend the first forecast day is a Tuesday.
    """
    span = F.sequence(last, F.date_add(last, 2 * (h + 1) + 3))
    weekdays = F.filter(span, lambda d: F.weekday(d) < 5)
    return F.slice(weekdays, 2, h)
