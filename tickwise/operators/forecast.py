"""Forecast and evaluation.

Learned models are fitted by ``operators.linear`` (one pass, all tickers and
horizons); prediction, inverse scaling and error metrics are column expressions.  Per-sample predictions are arrays indexed by horizon.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .align import future_bdays


def naive_predictions(x_close: Column, h: int, kind: str = "last") -> Column:
    """Naive forecasts from the window of closes: last value, drift, or moving average."""
    n = F.size(x_close)
    last = F.element_at(x_close, -1)
    if kind == "last":
        return F.array_repeat(last, h)
    if kind == "mean":
        mean = F.aggregate(x_close, F.lit(0.0), lambda a, v: a + v) / n
        return F.array_repeat(mean, h)
    if kind == "drift":
        slope = (last - F.element_at(x_close, 1)) / (n - 1)
        return F.transform(F.sequence(F.lit(1), F.lit(h)), lambda k: last + slope * k)
    raise ValueError(kind)


def forecast_naive(samples: DataFrame, h: int, kinds: Sequence[str] = ("last", "mean", "drift"),
                   close_idx: int = 0) -> DataFrame:
    """Add one prediction array per naive model; ``x`` holds the steps, ``close_idx``
    is the index of the close inside a step."""
    xc = F.transform(F.col("x"), lambda s: s[close_idx])
    out = samples
    for k in kinds:
        out = out.withColumn(f"pred_{k}", naive_predictions(xc, h, k))
    return out


def horizon_rows(df: DataFrame, pred: str, actual: str = "y", keep: Sequence[str] = ()) -> DataFrame:
    """One row per (sample, horizon day): day 1..h, predicted, actual."""
    z = F.arrays_zip(F.col(pred).alias("p"), F.col(actual).alias("a"))
    return df.select(*keep, F.posexplode(z).alias("_k", "_z")).select(
        *keep, (F.col("_k") + 1).alias("day"), F.col("_z.p").alias("predicted"), F.col("_z.a").alias("actual")
    )


def ape(pred: Column, actual: Column) -> Column:
    return F.abs(pred - actual) / actual


def mape(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """mean(|p - a| / a) over all (sample, day) rows per group."""
    g = rows.groupBy(*by) if by else rows.groupBy()
    return g.agg(F.avg(ape(F.col("predicted"), F.col("actual"))).alias("mape"), F.count(F.lit(1)).alias("n"))


def ape_by_day(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Error per forecast day."""
    return rows.groupBy(*by, "day").agg(F.avg(ape(F.col("predicted"), F.col("actual"))).alias("mape"))


def mse(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """P5: mean squared error over samples x horizons."""
    g = rows.groupBy(*by) if by else rows.groupBy()
    return g.agg(F.avg(F.pow(F.col("predicted") - F.col("actual"), 2)).alias("mse"))


def compare(actual: DataFrame, pred: DataFrame, by: Sequence[str] = ("ticker",)) -> DataFrame:
    """Actual vs predicted by date; dates on one side only are kept (full outer join)."""
    a = actual.select(*by, F.col("date"), F.col("close").alias("actual"))
    p = pred.select(*by, F.col("date"), F.col("predicted"))
    return a.join(p, on=[*by, "date"], how="full_outer")


def assemble_forecast(df: DataFrame, last_date: str, preds: str, h: int, keep: Sequence[str] = ("ticker",)) -> DataFrame:
    """Zip the next ``h`` business days after ``last_date`` with the predicted prices."""
    z = F.arrays_zip(future_bdays(F.col(last_date), h).alias("d"), F.col(preds).alias("p"))
    return df.select(*keep, F.posexplode(z).alias("_k", "_z")).select(
        *keep, (F.col("_k") + 1).alias("day"), F.col("_z.d").alias("date"), F.col("_z.p").alias("predicted_price")
    )


def backtest(samples: DataFrame, pasts: Sequence[int], h: int, by: Sequence[str] = ("ticker",)) -> DataFrame:
    """P10: rolling-origin backtest, all origins in one pass.

    For ``past`` = p the input window ends p rows before the last row and the
    actuals are the next h rows (T8).  Counting samples from the newest one
    (rank 0 ends h rows before the end), that sample has rank p - h; origins
    with p < h have no complete actuals and are skipped.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(F.col("pos").desc())
    ranks = [p - h for p in pasts if p >= h]
    return (
        samples.withColumn("_r", F.row_number().over(w) - 1)
        .filter(F.col("_r").isin(ranks))
        .withColumn("past", F.col("_r") + F.lit(h))
        .drop("_r")
    )


def forecast_recursive(df: DataFrame, coef, intercept: float, h: int, x: str = "x", out: str = "pred") -> DataFrame:
    """Predict one step, drop the oldest value, append the prediction, repeat ``h`` times.

    ``x`` is the window of the single series (array<double>); the linear model is
    evaluated as a column expression (coefficients are a small literal array).
    """
    w = F.array(*[F.lit(float(c)) for c in coef])
    n = len(coef)
    win = F.col(x)
    preds = []
    for _ in range(h):
        p = F.aggregate(F.zip_with(win, w, lambda a, b: a * b), F.lit(float(intercept)), lambda acc, v: acc + v)
        preds.append(p)
        win = F.concat(F.slice(win, 2, n - 1), F.array(p))
    return df.withColumn(out, F.array(*preds))
