"""Linear models from one pass over the samples.

Everything a least-squares fit needs of the samples is their moments: the
count, the means and the centred products of inputs and targets.  Tasks compute
the moments of their rows, and moments are merged (Chan's formula, so large
means cost no digits); a fit for all horizons, its losses on any split, a whole
gradient descent with early stopping and every origin of a backtest are then
solved from matrices of (inputs + targets)^2 numbers, however many samples
there are.

Samples are rows with ``x: array<double>`` (p inputs) and ``y: array<double>``
(h targets).  Rows with a null array, a null, NaN or infinite entry take no part.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAN_IN, LEVELS = 64, 3  # moments of up to 64 tasks are merged in one; three levels serve 64^3 tasks


@dataclass
class Moments:
    """Count, means and centred products of (x, y) rows."""
    n: int
    mean: np.ndarray
    scatter: np.ndarray

    @staticmethod
    def of(z: np.ndarray) -> Moments:
        mean = z.mean(axis=0)
        c = z - mean
        return Moments(len(z), mean, c.T @ c)

    def merged(self, other: Moments) -> Moments:
        n = self.n + other.n
        d = other.mean - self.mean
        return Moments(n, self.mean + d * (other.n / n), self.scatter + other.scatter + np.outer(d, d) * (self.n * other.n / n))


def _row(key: tuple, part: int, m: Moments) -> tuple:
    return (*key, part, m.n, m.mean.tobytes(), m.scatter.tobytes())


def _from(n, mean, scatter) -> Moments:
    mean = np.frombuffer(mean)
    return Moments(int(n), mean, np.frombuffer(scatter).reshape(len(mean), len(mean)))


def moments(df: DataFrame, by: Sequence[str] = (), x: str = "x", y: str = "y") -> DataFrame:
    """(by..., part, n, mean, scatter): the moments of the samples, one row per ``by`` group.

    Only matrices are shuffled, in up to three levels, so a group that holds most
    samples is merged from its tasks' matrices like any other.
    """
    by = list(by)
    whole = F.expr(f"{x} IS NOT NULL AND {y} IS NOT NULL AND NOT exists(concat({x}, {y}), v -> v IS NULL OR isnan(v) OR abs(v) = double('infinity'))")
    rows = df.filter(whole).select(*by, F.concat(F.col(x), F.col(y)).cast("array<double>").alias("_z"))
    schema = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by) + "part long, n long, mean binary, scatter binary"
    names = [*by, "part", "n", "mean", "scatter"]

    def partial(batches):
        from pyspark import TaskContext
        held: dict[tuple, Moments] = {}
        for pdf in batches:
            groups = pdf.groupby(by, dropna=False, sort=False) if by else [((), pdf)]
            for key, part in groups:
                m = Moments.of(np.stack(part["_z"].to_numpy())) if len(part) else None
                if m is not None:
                    held[key] = held[key].merged(m) if key in held else m
        task = TaskContext.get().partitionId()
        yield pd.DataFrame([_row(k, task, m) for k, m in held.items()], columns=names)

    def merge(pdf):
        pdf = pdf.sort_values("part")
        total = None
        for n, mean, scatter in zip(pdf["n"], pdf["mean"], pdf["scatter"]):
            m = _from(n, mean, scatter)
            total = m if total is None else total.merged(m)
        head = pdf.iloc[0]
        return pd.DataFrame([_row(tuple(head[c] for c in by), int(head["part"]) // FAN_IN, total)], columns=names)

    found = rows.mapInPandas(partial, schema)
    for _ in range(LEVELS):
        found = found.groupBy(*by, F.floor(F.col("part") / FAN_IN)).applyInPandas(merge, schema)
    return found


def collect_moments(df: DataFrame, by: str | None = None, x: str = "x", y: str = "y") -> dict:
    """Group value -> Moments (key None without ``by``); for a few groups, such as splits or origins."""
    return {r[by] if by else None: _from(r.n, r["mean"], r.scatter) for r in moments(df, [by] if by else [], x, y).collect()}


@dataclass
class Linear:
    """y = intercept + coef x; ``coef`` has one row per target."""
    coef: np.ndarray
    intercept: np.ndarray

    def predictions(self, x: Column) -> Column:
        """Array of the targets' predictions."""
        return linear_predictions(x, F.lit([[float(c) for c in row] for row in self.coef]), F.lit([float(c) for c in self.intercept]))


def linear_predictions(x: Column, coef: Column, intercept: Column) -> Column:
    """Array of intercept + coef x, from columns of arrays."""
    dots = F.transform(coef, lambda row: F.aggregate(F.zip_with(x, row, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    return F.zip_with(dots, intercept, lambda d, c: d + c)


def solve(m: Moments, h: int, l2: float = 0.0) -> Linear:
    """The least squares fit with penalty ``l2`` / 2 on squared coefficients beside half the mean squared error
    (the intercept is free).  Inputs without variance, or that repeat others, get the smallest coefficients that fit."""
    p = len(m.mean) - h
    a = m.scatter[:p, :p] / m.n + l2 * np.eye(p)
    b = m.scatter[:p, p:] / m.n
    coef = np.linalg.lstsq(a, b, rcond=None)[0].T if p else np.zeros((h, 0))
    return Linear(coef, m.mean[p:] - coef @ m.mean[:p])


def mse(m: Moments, model: Linear) -> np.ndarray:
    """Mean squared error of each target on the samples behind the moments."""
    b = np.hstack([-model.coef, np.eye(len(model.coef))])
    bias = b @ m.mean - model.intercept
    return np.einsum("ij,jk,ik->i", b, m.scatter / m.n, b) + bias ** 2


def descend(train: Moments, val: Moments, h: int, l2: float = 1e-4, rate: float = 1.0, patience: int = 10,
            max_iter: int = 1000) -> tuple[Linear, list[tuple[int, float, float, bool]]]:
    """Gradient descent on the training loss, stopped by the validation loss.

    Losses are the mean squared error over all targets plus ``l2`` times the
    squared coefficients.  The descent starts from zero coefficients with steps
    of ``rate`` over the gradient's Lipschitz constant, keeps the intercept at
    its optimum, stops when the validation loss has not fallen for ``patience``
    iterations, and returns the weights of the best iteration, not the last,
    with (iteration, train_loss, val_loss, best) of all.
    """
    p = len(train.mean) - h
    xx, xy = train.scatter[:p, :p] / train.n, train.scatter[:p, p:] / train.n
    step = rate / (2 * (np.linalg.eigvalsh(xx)[-1] / h + l2)) if p else 0.0
    coef = np.zeros((h, p))
    curve, best = [], None
    for i in range(max_iter + 1):
        model = Linear(coef, train.mean[p:] - coef @ train.mean[:p])
        penalty = l2 * float((coef ** 2).sum())
        losses = float(mse(train, model).mean()) + penalty, float(mse(val, model).mean()) + penalty
        curve.append((i, *losses))
        if best is None or losses[1] < best[1]:
            best = (i, losses[1], model)
        if i - best[0] >= patience:
            break
        coef = coef - step * (2 / h * (coef @ xx - xy.T) + 2 * l2 * coef)
    return best[2], [(i, a, b, i == best[0]) for i, a, b in curve]


def backtest_linear(samples: DataFrame, pasts: Sequence[int], h: int, by: Sequence[str] = ("ticker",), x: str = "x", y: str = "y",
                    l2: float = 0.0, least: int = 1) -> DataFrame:
    """P10 with a learned model: every origin's own refit, all origins from one pass.

    Counting a key's samples from its newest (rank 0), the origin ``past`` is
    forecast for the sample of rank past - h and learns, over all keys, from the
    samples of rank >= past, whose targets are known at the origin.  A sample
    enters the moments of the newest origin that knows it; the origins' moments are
    their running sums from the oldest on, so each refit costs one merge and one
    solve.  Origins before h rows, or that know fewer than ``least`` samples, are left out.

    Returns the forecast samples with ``past`` and ``pred``.
    """
    origins = sorted({p for p in pasts if p >= h})
    if not origins:
        return samples.withColumns({"past": F.lit(0), "pred": F.col(y)}).limit(0)
    newest = Window.partitionBy(*by).orderBy(F.col("pos").desc())
    ranked = samples.withColumn("_r", F.row_number().over(newest) - 1)
    bounds = F.lit(origins)
    known = ranked.withColumn("_origin", F.size(F.filter(bounds, lambda p: p <= F.col("_r"))) - 1).filter(F.col("_origin") >= 0)
    parts = collect_moments(known, "_origin", x, y)  # one matrix per origin
    total, fits = None, []
    for i in range(len(origins) - 1, -1, -1):
        if i in parts:
            total = parts[i] if total is None else total.merged(parts[i])
        if total is not None and total.n >= least:
            fit = solve(total, h, l2)
            fits.append((origins[i], fit.coef.tolist(), fit.intercept.tolist()))
    models = samples.sparkSession.createDataFrame(fits, "past INT, _coef ARRAY<ARRAY<DOUBLE>>, _intercept ARRAY<DOUBLE>")
    asked = ranked.withColumn("past", (F.col("_r") + h).cast("int")).join(models, "past")
    return asked.withColumn("pred", linear_predictions(F.col(x), F.col("_coef"), F.col("_intercept"))).drop("_r", "_coef", "_intercept")
