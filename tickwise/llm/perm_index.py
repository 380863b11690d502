"""Approximate nearest neighbours by a permutation index.

Pivots come from a bounded sample (``SAMPLE`` vectors per dimension, by a hash of
the id), picked one after the other as the vector farthest from those picked, so
that a large group of near copies gives one pivot, not many.  A vector is represented by its ``PREFIX`` nearest pivots in order, and
posted under each of them, with its rank there, in the pivots' inverted files.
The files are kept per block of about ``ROWS`` vectors (so no list grows with
the data).  A query goes to every block: its pivots' lists give the footrule
distance to every vector that shares a pivot,

    sum over pivots |rank in q - rank in x|  =  L (L + 1) - 2 sum over shared pivots (L - max(rank)),

with rank L for pivots outside a prefix of length L.  The ``RERANK`` share of a
block with the least footrule (ties to the smaller id) is reranked by exact
cosine on the original vectors, and the best ``k`` of a block compete for the
final ``k``.  Queries are handled in sets of ``QUERIES`` per task.

Copies of a vector share a permutation, so a block holds each different vector
once, with its smallest ``k + 1`` ids: enough for any answer, as ties go to the
smaller id and a query leaves out only itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .vectors import clean_vectors, cosine, stack, unit

SAMPLE = 4096     # vectors per dimension that the index is fit on
PIVOTS = 256      # pivots per dimension
PREFIX = 96       # nearest pivots that represent a vector
ROWS = 8192       # different vectors of a block (about)
RERANK = 0.1      # share of a block that is reranked
LEAST = 512       # vectors of a block that are reranked at least
QUERIES = 1024    # queries of a task
MAX_DIMS = 64     # different dimensions; more are refused
K = 5


def fit_pivots(vectors: DataFrame, pivots: int = PIVOTS) -> dict[int, np.ndarray]:
    """Unit pivots by dimension, spread over a sample: the vectors with the smallest hashes of their ids."""
    counts = vectors.groupBy("dim").count().limit(MAX_DIMS + 1).collect()
    if len(counts) > MAX_DIMS:
        raise ValueError(f"more than {MAX_DIMS} dimensions")
    out = {}
    for row in counts:  # a handful of dimensions, SAMPLE vectors each
        some = vectors.where(F.col("dim") == row["dim"]).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("raw").toPandas()
        x = unit(stack(some["raw"].tolist()))
        picked, nearest_pivot = [0], x @ x[0]
        while len(picked) < min(pivots, len(x)):
            picked.append(int(nearest_pivot.argmin()))
            nearest_pivot = np.maximum(nearest_pivot, x @ x[picked[-1]])
        out[row["dim"]] = x[picked]
    return out


def permutations(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Nearest pivots in order (ties to the earlier pivot), up to ``prefix``."""
    return np.argsort(-(unit(x) @ pivots.T), axis=1, kind="stable")[:, :prefix].astype(np.int16)


def _search_block(qp: np.ndarray, xp: np.ndarray, n_rows: int, n_pivots: int, n: int):
    """For each query the n rows of the block with the least footrule; all rows, if there are fewer."""
    length = xp.shape[1]
    order = np.argsort(xp.ravel(), kind="stable")           # the inverted files, one after the other
    rows, ranks = (order // length).astype(np.int32), (order % length).astype(np.int16)
    cuts = np.searchsorted(xp.ravel()[order], np.arange(n_pivots + 1))
    for i in range(len(qp)):
        shared = np.zeros(n_rows, np.int32)
        for rank, p in enumerate(qp[i].tolist()):
            lo, hi = cuts[p], cuts[p + 1]
            shared[rows[lo:hi]] += length - np.maximum(ranks[lo:hi], rank)
        near = np.flatnonzero(shared >= np.partition(shared, -n)[-n]) if n_rows > n else np.arange(n_rows)
        yield near[np.argsort(-shared[near], kind="stable")][:n]   # rows are sorted by id: ties to the smaller


def nearest(table: DataFrame, is_query: Column, k: int = K, pivots: int = PIVOTS, prefix: int = PREFIX,
            rerank: float = RERANK, rows_per_block: int = ROWS, queries_per_task: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for every row where ``is_query``.

    Unusable vectors (see ``clean_vectors``) are neither queries nor candidates;
    vectors of different dimension are not compared; rows that repeat a vec_id
    with the same vector count once; fewer candidates give fewer rows; an empty
    table gives none; further columns are ignored.
    """
    vectors = written(clean_vectors(table).distinct(), "perm-vectors")
    model = fit_pivots(vectors, pivots)
    shipped = table.sparkSession.sparkContext.broadcast(model)  # at most MAX_DIMS x pivots vectors

    def represent(batches):
        for pdf in batches:
            perm = [permutations(stack([r]), shipped.value[d], prefix)[0].tobytes() for d, r in zip(pdf["dim"], pdf["raw"], strict=True)]
            yield pdf.assign(perm=perm)

    # per different vector its k + 1 smallest ids: the limit is applied before the shuffle, too
    smallest = Window.partitionBy("dim", "raw").orderBy("vec_id")
    classes = (vectors.withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= k + 1)
               .groupBy("dim", "raw").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    index = written(classes.mapInPandas(represent, "dim int, raw binary, ids array<long>, perm binary"), "perm-index")
    asked = written(vectors.where(is_query).mapInPandas(represent, "vec_id long, dim int, raw binary, perm binary"), "perm-queries")
    sizes = index.groupBy("dim").agg(F.ceil(F.count("*") / rows_per_block).cast("int").alias("n_blocks")).join(
        asked.groupBy("dim").agg(F.ceil(F.count("*") / queries_per_task).cast("int").alias("n_sets")), "dim")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    data = (index.join(sizes, "dim").withColumn("block", F.pmod(F.xxhash64("raw"), F.col("n_blocks")).cast("int"))
            .withColumn("qset", upto("n_sets")).select("dim", "block", "qset", "raw", "ids", "perm"))
    asks = (asked.join(sizes, "dim").withColumn("qset", F.pmod(F.xxhash64("vec_id"), F.col("n_sets")).cast("int"))
            .withColumn("block", upto("n_blocks")).select("dim", "block", "qset", "vec_id", "raw", "perm"))

    def search(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        x = x.assign(first=[i[0] for i in x["ids"]]).sort_values("first", ignore_index=True)
        qv, xv = stack(q["raw"].tolist()), stack(x["raw"].tolist())
        perm = lambda col: np.frombuffer(b"".join(col), dtype=np.int16).reshape(len(col), -1)
        ids = x["ids"].tolist()
        n = max(LEAST, int(np.ceil(rerank * len(x))))
        found = _search_block(perm(q["perm"]), perm(x["perm"]), len(x), len(shipped.value[int(q["dim"].iloc[0])]), n)
        out = []
        for i, (query_id, near) in enumerate(zip(q["vec_id"].tolist(), found, strict=True)):
            scores = cosine(np.broadcast_to(qv[i], (len(near), qv.shape[1])), xv[near])
            least = np.partition(scores, -(k + 1))[-(k + 1)] if len(scores) > k + 1 else -2.0
            best = [(-s, v) for s, r in zip(scores.tolist(), near.tolist(), strict=True) if s >= least for v in ids[r] if v != query_id]
            out.extend((query_id, v, -s) for s, v in sorted(best)[:k])
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    keys = ["dim", "block", "qset"]
    found = asks.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
