"""Vectors as bytes: cleaning, classes of equal vectors, decoding in tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clean_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, dim, raw): the usable rows; raw holds the components as little-endian doubles.

    Left out: null and empty vectors, zero vectors, vectors that hold null or
    non-finite components, rows without vec_id.
    """
    def run(batches):
        for pdf in batches:
            out = []
            for i, v in zip(pdf["vec_id"], pdf["embedding"], strict=True):
                x = np.asarray(v, dtype="<f8")
                if x.size and np.isfinite(x).all() and x.any():
                    out.append((i, x.size, x.tobytes()))
            yield pd.DataFrame(out, columns=["vec_id", "dim", "raw"])

    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where("vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL)")
    return rows.mapInPandas(run, "vec_id long, dim int, raw binary")


def stack(raw) -> np.ndarray:
    """Matrix of equally long raw vectors."""
    return np.frombuffer(b"".join(raw), dtype="<f8").reshape(len(raw), -1)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component near one: exact, and safe from overflow."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one."""
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cosine of original vectors in double precision."""
    a, b = _scaled(a), _scaled(b)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
