"""Whitening of embeddings by a bidiagonal qd solver.

Four passes over the table, each one scan without a shuffle of vectors: exact
integer sums per dimension; blockwise QR of the centred rows, one triangular
factor per task, stacked and factored again four at a time until one is left;
the Gram matrix of the whitened rows, for the error; the result.  The factor's
singular values and vectors come from ``bidiagonal`` in the task that makes the
last factor.  Only d by d numbers per task and the chosen directions (at most
``components`` by d) ever leave a task, whatever the number of rows.

Entries c become whole numbers x = floor(64 c) + 1,000,000, so sums, centred
numerators n x - S and deviations are exact.  Left out: rows whose vector is
null or empty, holds null or non-finite entries, or holds an entry beyond 2^52,
whose x has no exact sums.  Vectors of different length are whitened apart, each
length with its own fit list; lengths are expected to be few (the directions of
each are kept by the driver).  Directions without variance (singular value
below 1e-11 of the largest) have no whitened value and are left out, so one
row, equal rows or an empty table give no rows.  Repeated rows count as often
as they occur and a null vec_id stays null; further columns are ignored.  A
deviation that does not fit a long is null.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bidiagonal import right_singular
from .common import written

COMPONENTS = 32
SCALE, OFFSET = 64, 1_000_000
ENTRY = 2.0 ** 52        # largest entry with an exact x
RANK = 1e-11             # singular values below this share of the largest are no direction
BLOCK = 4096             # rows factored at once
FAN_IN = 4               # triangular factors stacked in one task
_EXACT = 1 << 62         # whole numbers up to here are worked on as 64-bit numbers, others as Python's


def whole_numbers(table: DataFrame) -> DataFrame:
    """(vec_id, dim, x array<long>): the usable rows."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(F.expr(f"v IS NOT NULL AND size(v) > 0 AND NOT exists(v, c -> c IS NULL OR isnan(c) OR abs(c) > {ENTRY})"))
    return rows.select("vec_id", F.size("v").alias("dim"), F.expr(f"transform(v, c -> floor({SCALE} * c) + {OFFSET}L)").alias("x"))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, row numbers, x as a matrix) of each length in a batch."""
    dims = batch.column("dim").to_numpy()
    x = batch.column("x")
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        yield dim, at, x.take(pa.array(at)).flatten().to_numpy().reshape(len(at), dim)


def _numerators(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exactly."""
    if n * max(int(x.max()), -int(x.min())) < _EXACT // 2 and max(map(abs, sums.tolist())) < _EXACT // 2:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def _deviations(top: np.ndarray) -> list[int | None]:
    """Sums of squares, exactly; null where they do not fit a long."""
    if top.dtype != object and top.shape[1] * float(np.abs(top).max()) ** 2 < _EXACT:
        return (top * top).sum(axis=1).tolist()
    found = (top.astype(object) ** 2).sum(axis=1).tolist()
    return [x if x < 1 << 63 else None for x in found]


def _sums(rows: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """dim -> (n, exact sums of x per dimension)."""
    def run(batches):
        total: dict[int, list] = {}
        for batch in batches:
            for dim, at, x in _matrices(batch):
                small = len(at) * max(int(x.max()), -int(x.min())) < _EXACT
                part = (x if small else x.astype(object)).sum(axis=0).astype(object)
                n, s = total.get(dim, (0, 0))
                total[dim] = (n + len(at), s + part)
        for dim, (n, s) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim] * dim, pa.int32()), pa.array([n] * dim, pa.int64()),
                                              pa.array(range(dim), pa.int32()), pa.array(map(str, s), pa.string())],
                                             ["dim", "n", "pos", "s"])

    parts = rows.select("dim", "x").mapInArrow(run, "dim int, n long, pos int, s string")
    total = parts.groupBy("dim", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found: dict[int, tuple[int, np.ndarray]] = {}
    by = defaultdict(list)
    for r in total.collect():  # one number per dimension
        by[r.dim].append((r.pos, r.n, int(r.s)))
    for dim, entries in by.items():
        entries.sort()
        found[dim] = (entries[0][1], np.array([s for _, _, s in entries], dtype=object))
    return found


def _triangle(stack: np.ndarray) -> np.ndarray:
    """The square factor R of a stack of rows (rows of zeros make up for fewer than d)."""
    r = np.linalg.qr(stack, mode="r")
    return np.vstack([r, np.zeros((stack.shape[1] - len(r), stack.shape[1]))]) if len(r) < stack.shape[1] else r


def _factors(rows: DataFrame, sums: dict) -> DataFrame:
    """(dim, part, r): the triangular factor of each task's centred rows."""
    def run(batches):
        from pyspark import TaskContext
        factor: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, at, x in _matrices(batch):
                n, s = sums[dim]
                for i in range(0, len(at), BLOCK):
                    centred = _numerators(x[i:i + BLOCK], n, s).astype(float) / n
                    factor[dim] = _triangle(np.vstack([factor[dim], centred]) if dim in factor else centred)
        part = TaskContext.get().partitionId()
        for dim, r in factor.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([part], pa.int32()), pa.array([r.tobytes()], pa.binary())],
                                             ["dim", "part", "r"])

    return rows.select("dim", "x").mapInArrow(run, "dim int, part int, r binary")


def _stacked(pdf: pd.DataFrame) -> np.ndarray:
    dim = int(pdf["dim"].iloc[0])
    return _triangle(np.vstack([np.frombuffer(r).reshape(dim, dim) for r in pdf.sort_values("part")["r"]]))


def directions(rows: DataFrame, sums: dict, components: int = COMPONENTS) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """dim -> (eigenvalues, unit eigenvectors as columns, trace) of the covariance, by falling eigenvalue."""
    factors = written(_factors(rows, sums), "whitening-factors")
    while (factors.agg(F.max("part")).first()[0] or 0) >= FAN_IN:
        def merge(pdf):
            return pd.DataFrame({"dim": pdf["dim"].iloc[:1], "part": pdf["part"].iloc[:1] // FAN_IN, "r": [_stacked(pdf).tobytes()]})
        factors = written(factors.groupBy("dim", F.floor(F.col("part") / FAN_IN)).applyInPandas(merge, factors.schema), "whitening-factors")
    sizes = {dim: n for dim, (n, _) in sums.items()}

    def solve(pdf):
        dim = int(pdf["dim"].iloc[0])
        r = _stacked(pdf)
        s, v = right_singular(r, components)
        keep = s > RANK * s.max(initial=0.0)
        return pd.DataFrame({"dim": [dim], "e": [(s[keep] ** 2 / sizes[dim]).tobytes()], "v": [v[:, keep].tobytes()],
                             "trace": [float((r * r).sum() / sizes[dim])]})

    solved = factors.groupBy("dim").applyInPandas(solve, "dim int, e binary, v binary, trace double").collect()
    return {r.dim: (np.frombuffer(r.e), np.frombuffer(r.v).reshape(r.dim, -1), r.trace) for r in solved}


def _whitened(top: np.ndarray, n: int, e: np.ndarray, v: np.ndarray) -> np.ndarray:
    return (top.astype(float) / n) @ v / np.sqrt(e)


def identity_errors(rows: DataFrame, sums: dict, found: dict) -> dict[int, float]:
    """dim -> largest absolute entry of the whitened rows' covariance minus the identity."""
    def run(batches):
        total: dict[int, list] = {}
        for batch in batches:
            for dim, _, x in _matrices(batch):
                n, s = sums[dim]
                z = _whitened(_numerators(x, n, s), n, *found[dim][:2])
                z = np.hstack([np.ones((len(z), 1)), z])
                total[dim] = total.get(dim, 0) + z.T @ z
        for dim, gram in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim] * gram.size, pa.int32()), pa.array(range(gram.size), pa.int32()),
                                              pa.array(gram.ravel(), pa.float64())], ["dim", "pos", "g"])

    parts = rows.select("dim", "x").mapInArrow(run, "dim int, pos int, g double")
    grams = defaultdict(dict)
    for r in parts.groupBy("dim", "pos").agg(F.sum("g").alias("g")).collect():  # (components + 1) squared numbers
        grams[r.dim][r.pos] = r.g
    errors = {}
    for dim, cells in grams.items():
        k = len(found[dim][0]) + 1
        gram = np.array([cells[i] for i in range(k * k)]).reshape(k, k) / sums[dim][0]
        covariance = gram[1:, 1:] - np.outer(gram[0, 1:], gram[0, 1:])
        errors[dim] = float(np.abs(covariance - np.eye(k - 1)).max(initial=0.0))
    return errors


def whiten(table: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, dim): one row per usable row and component."""
    rows = whole_numbers(table)
    sums = _sums(rows)
    found = directions(rows, sums, components) if sums else {}
    errors = identity_errors(rows, sums, found) if sums else {}

    def run(batches):
        for batch in batches:
            ids = batch.column("vec_id")
            for dim, at, x in _matrices(batch):
                n, s = sums[dim]
                e, v, trace = found[dim]
                k = len(e)
                if not k:
                    continue
                top = _numerators(x, n, s)
                z = _whitened(top, n, e, v)
                each = np.repeat(np.arange(len(at)), k)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(at[each])), pa.array(np.tile(np.arange(1, k + 1), len(at)), pa.int32()),
                     pa.array(np.full(len(each), n), pa.int64()), pa.array(_deviations(top), pa.int64()).take(pa.array(each)),
                     pa.array(z.ravel()), pa.array(np.tile(e / trace, len(at))), pa.array(np.full(len(each), errors[dim])),
                     pa.array(np.full(len(each), dim), pa.int32())],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "dim"])

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, "
                                "identity_error double, dim int")
