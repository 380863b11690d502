"""Whitening against a direct eigen decomposition, the solver against dense SVDs, and edge cases."""

import numpy as np
import pytest

from tickwise.llm import bidiagonal, whitening
from tickwise.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
RNG = np.random.default_rng(5)
Q = np.linalg.qr(RNG.normal(size=(40, 40)))[0]
MATRICES = {
    "random": RNG.normal(size=(200, 48)),
    "graded": RNG.normal(size=(200, 48)) * np.logspace(0, -10, 48),
    "repeated": Q @ np.diag([3.0] * 10 + [2.0] * 10 + [1.0] * 20) @ Q[::-1],
    "nearly equal": Q @ np.diag(1 + 1e-9 * RNG.normal(size=40)) @ Q.T,
    "singular": np.diag(np.abs(np.arange(-9, 10)).astype(float)) + np.diag(np.ones(18), 1),
    "diagonal": np.diag([3.0, 3, 2, 0, 1]),
    "three rows": RNG.normal(size=(3, 12)),
    "one": np.ones((4, 1)),
    "zero": np.zeros((5, 5)),
}


@pytest.mark.parametrize("name", MATRICES)
def test_solver_matches_dense_svd(name):
    a = MATRICES[name]
    s, v = bidiagonal.right_singular(whitening._triangle(a), a.shape[1])
    dense = np.zeros(a.shape[1])
    dense[:min(a.shape)] = np.linalg.svd(a, compute_uv=False)
    top = max(dense[0], 1e-300)
    assert np.abs(s - dense).max() <= 1e-13 * top
    assert np.abs(a.T @ (a @ v) - v * s ** 2).max() <= 1e-12 * top ** 2
    assert np.abs(v.T @ v - np.eye(v.shape[1])).max() <= 1e-11


def test_graded_values_keep_relative_accuracy():
    d, b = np.logspace(0, -60, 30), np.logspace(-1, -59, 29) / 8
    got = np.sqrt(bidiagonal.squared_singular_values(d, b))
    from fractions import Fraction
    product = 1
    for x in d:
        product *= Fraction(float(x))
    found = 1
    for x in got:
        found *= Fraction(float(x))
    assert abs(float(found / product) - 1) < 1e-12  # the determinant, far below the largest value's rounding


def direct(vectors):
    x = np.floor(64 * np.array(vectors, dtype=float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    centred = (n * x - s) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    return n, ((n * x - s) ** 2).sum(axis=1), centred @ v / np.sqrt(np.maximum(e, 1e-300)), e / e.sum()


def test_query_matches_direct_computation(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    usable = [r for r in rows if r.embedding is not None and np.isfinite(np.array(r.embedding, dtype=float)).all()]
    n, deviation, z, explained = direct([r.embedding for r in usable])
    got = QUERIES["op12_whitening"](spark, SF).toPandas().sort_values(["vec_id", "component"])
    assert len(got) == 32 * len(usable) and set(got["n"]) == {n}
    by = {r.vec_id: i for i, r in enumerate(usable)}
    order = [by[i] for i in got["vec_id"].iloc[::32]]
    assert got["deviation"].to_numpy().reshape(-1, 32)[:, 0].tolist() == deviation[order].tolist()
    mine = got["whitened"].to_numpy().reshape(-1, 32)
    theirs = z[order][:, :32]
    assert np.abs(mine * np.sign((mine * theirs).sum(axis=0)) - theirs).max() < 1e-9
    assert np.abs(got["explained"].to_numpy()[:32] / explained[:32] - 1).max() < 1e-10
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-10


def test_edges(spark):
    schema = "vec_id long, embedding array<double>, dim string, x int"
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.0]), (2, [0.0, -5.5, 3.0]), (None, [2.0, 9.0, 3.0]), (3, None), (4, []), (5, [1.0, None, 2.0]),
            (6, [nan, 1.0, 2.0]), (7, [inf, 1.0, 2.0]), (8, [1.0, 2.0]), (9, [1e300, 1.0, 0.0]), (10, [2.0 ** 40, 1.0]), (11, [-(2.0 ** 51), 1.0])]
    got = whitening.whiten(spark.createDataFrame([(*r, "mine", 1) for r in rows], schema)).collect()
    three = [r for r in got if r.dim == 3]
    n, deviation, z, explained = direct([[1, 2, 3], [1, 2, 3], [0, -5.5, 3], [2, 9, 3]])
    assert len(three) == 4 * 2 and all(r.n == 4 for r in three)  # the third entry has no variance
    assert sorted(r.deviation for r in three if r.component == 1) == sorted(deviation.tolist())
    for c in (1, 2):
        mine = sorted((r.vec_id or 0, abs(r.whitened)) for r in three if r.component == c)
        assert np.allclose(mine, sorted(zip((1, 1, 2, 0), np.abs(z[:, c - 1]), strict=True)))
        assert {round(r.explained, 12) for r in three if r.component == c} == {round(explained[c - 1], 12)}
    two = [r for r in got if r.dim == 2]
    assert {r.vec_id for r in two} == {8, 10, 11} and all(r.deviation is None for r in two if r.vec_id == 11)
    one = spark.createDataFrame([(1, [1.0, 2.0], "", 0), (2, [1.0, 2.0], "", 0)], schema)
    assert whitening.whiten(one).count() == 0 and whitening.whiten(one.limit(0)).count() == 0


def test_partitioning_does_not_matter(spark):
    v = np.random.default_rng(2).normal(size=(300, 12))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(v)], "vec_id long, embedding array<double>")
    found = [whitening.whiten(df.repartition(k), 5).toPandas().sort_values(["vec_id", "component"]) for k in (1, 37)]
    a, b = (f["whitened"].to_numpy().reshape(-1, 5) for f in found)
    assert np.abs(a * np.sign((a * b).sum(axis=0)) - b).max() < 1e-10
    assert found[0]["deviation"].tolist() == found[1]["deviation"].tolist()
