"""Moments, fits, early stopping and refits against direct computation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickwise.operators import linear as LN

RNG = np.random.default_rng(8)
SAMPLES = "k string, pos int, x array<double>, y array<double>"


def data(n, p, h, shift=0.0):
    x = RNG.normal(size=(n, p)) + shift
    return x, x @ RNG.normal(size=(p, h)) + 0.1 * RNG.normal(size=(n, h)) + 3


def frame(spark, x, y, keys=("a",)):
    return spark.createDataFrame([(keys[i % len(keys)], i // len(keys), a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))], SAMPLES)


def ridge(x, y, l2):
    xc, yc = x - x.mean(0), y - y.mean(0)
    coef = np.linalg.solve(xc.T @ xc / len(x) + l2 * np.eye(x.shape[1]), xc.T @ yc / len(x)).T
    return coef, y.mean(0) - coef @ x.mean(0)


@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_moments_do_not_depend_on_partitions_or_size_of_means(spark, shift):
    x, y = data(500, 4, 2, shift)
    df = frame(spark, x, y, ("a", "b", None))
    odd = spark.createDataFrame([("a", 0, None, [1.0, 1.0]), ("a", 0, [1.0, 2.0, None, 0.0], [1.0, 1.0]),
                                 ("a", 0, [1.0, 2.0, float("nan"), 0.0], [1.0, 1.0]), ("b", 0, [1.0, 2.0, 3.0, float("-inf")], [1.0, 1.0])], SAMPLES)
    z = np.hstack([x, y])
    for parts in (1, 13):
        found = LN.collect_moments(df.repartition(parts).union(odd), "k")
        for i, key in enumerate(("a", "b", None)):
            own = z[i::3]
            assert found[key].n == len(own)
            assert np.allclose(found[key].mean, own.mean(0), rtol=1e-12)
            assert np.allclose(found[key].scatter, np.cov(own.T, bias=True) * len(own), rtol=1e-8, atol=1e-6 if shift else 1e-9)
    assert LN.collect_moments(df.limit(0)) == {}


def test_fit_equals_ridge_and_the_library_regressor(spark):
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    x, y = data(300, 5, 3)
    df = frame(spark, x, y)
    m = LN.collect_moments(df)[None]
    for l2 in (0.0, 1e-4, 0.5):
        fit = LN.solve(m, 3, l2)
        coef, intercept = ridge(x, y, l2)
        assert np.allclose(fit.coef, coef) and np.allclose(fit.intercept, intercept)
        assert np.allclose(LN.mse(m, fit), ((x @ coef.T + intercept - y) ** 2).mean(0))
    rows = df.withColumn("f", array_to_vector("x")).withColumn("l", F.col("y")[1])
    other = LinearRegression(featuresCol="f", labelCol="l", solver="normal").fit(rows)
    assert np.allclose(LN.solve(m, 3).coef[1], other.coefficients.toArray())
    got = np.array([r.p for r in df.select(fit.predictions(F.col("x")).alias("p")).collect()])
    assert np.allclose(got, x @ coef.T + intercept)


def test_inputs_without_variance_get_no_weight(spark):
    x, y = data(60, 3, 1)
    x[:, 1] = 7.0
    fit = LN.solve(LN.collect_moments(frame(spark, x, y))[None], 1)
    assert abs(fit.coef[0, 1]) < 1e-12 and np.allclose(fit.coef[0, [0, 2]], ridge(x[:, [0, 2]], y, 0)[0])


def moments(x, y):
    return LN.Moments.of(np.hstack([x, y]))


def test_descent_keeps_the_best_weights_not_the_last():
    rng = np.random.default_rng(3)
    truth = rng.normal(size=(12, 2))
    x, v = rng.normal(size=(16, 12)) * np.logspace(0, -1.2, 12), rng.normal(size=(400, 12)) * np.logspace(0, -1.2, 12)
    y, w = x @ truth + rng.normal(size=(16, 2)), v @ truth + rng.normal(size=(400, 2))
    train, val = moments(x, y), moments(v, w)
    model, curve = LN.descend(train, val, 2, l2=1e-4, patience=10, max_iter=5000)
    losses = [c[2] for c in curve]
    best = int(np.argmin(losses))
    assert 0 < best < len(curve) - 1 == best + 10          # stopped ten iterations after the best
    assert [c[3] for c in curve].index(True) == best and sum(c[3] for c in curve) == 1
    assert np.isclose(LN.mse(val, model).mean() + 1e-4 * (model.coef ** 2).sum(), losses[best])
    assert all(a[1] >= b[1] for a, b in zip(curve, curve[1:]))  # the training loss goes on falling
    # every reported loss is the loss of the weights on the samples themselves
    assert np.isclose(((v @ model.coef.T + model.intercept - w) ** 2).mean() + 1e-4 * (model.coef ** 2).sum(), losses[best])
    assert losses[best] < losses[-1]


def test_descent_without_overfitting_reaches_the_solution():
    x, y = data(4000, 3, 2)
    m = moments(x, y)
    model, curve = LN.descend(m, m, 2, l2=0.0, max_iter=3000)
    assert np.allclose(model.coef, LN.solve(m, 2).coef, atol=1e-6) and curve[-1][2] <= curve[0][2]


def test_backtest_equals_refitting_each_origin(spark):
    x, y = data(180, 3, 2)
    keys = ("a", "b", "c")
    got = LN.backtest_linear(frame(spark, x, y, keys), [1, 2, 5, 8, 30, 59, 60, 61, 400], 2, by=["k"]).collect()
    rank = {(keys[i % 3], i // 3): 59 - i // 3 for i in range(180)}
    at = {(keys[i % 3], i // 3): i for i in range(180)}
    assert {r.past for r in got} == {2, 5, 8, 30, 59} and len(got) == 15
    for r in got:
        i = at[r.k, r.pos]
        assert rank[r.k, r.pos] == r.past - 2
        known = [at[k] for k, n in rank.items() if n >= r.past]
        fit = LN.solve(moments(x[known], y[known]), 2)
        assert np.allclose(r.pred, fit.coef @ x[i] + fit.intercept)
    assert LN.backtest_linear(frame(spark, x, y), [1], 2, by=["k"]).count() == 0
