r"""Ranked lexical search by branch and bound over document FP-trees.

Items (queries) are searched against all documents.  One pass over the texts
keeps of each document its length and its term vector restricted to the items'
terms; counts over those vectors give N, L and every term's df.  Then every task
puts its documents into FP-trees: the terms of a vector, most frequent first,
are a path, so vectors that start alike share it and exact copies end in one
leaf.  A branch keeps the largest tf of every term below it and the smallest m;
the score falls with m and rises with tf, so these bound the scores below.  Per
item a depth-first search visits the branches by falling bound and leaves out
those whose bound is under the item's current last place.  A task carries the
best of each item from tree to tree, so its output is at most ``k`` rows an item
and the search narrows as it goes.  No text is shuffled and nothing is cut:
every document's full vector can be reached.

Terms are the maximal matches of ``[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+`` in
the whole text, only A-Z lower-cased.  Score of a document: sum over the item's
terms, repeats included, of w * ((10^9 tf) div (1000 tf + 12 m)) with
w = floor(1000 ln((2N+2)/(2df+1))) and m = 100 - 25 + ((25 n N) div L).

Items are dealt into sets of about ``SET_TERMS`` terms, one search over the
vectors for each set, so what the driver and the tasks hold of them is bounded.
A null or empty text has no terms: such a document is not counted and an item
without terms finds nothing.  Equal scores rank by doc_id, null last.  Repeated
documents are documents of their own; repeated items count once, different texts
under one item_id are ranked apart.  Empty tables give no rows; further columns
are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

TOP = 20
SET_TERMS = 500_000    # distinct terms, summed over items, of one set of items
TREE_DOCS = 4096       # documents of one tree
TREE_TERMS = 1_000_000  # entries of their vectors, beyond which a tree is closed
LEAF = 128             # documents under a branch that is not split further
SALTS = 32             # first-level groups of the final ranking
K1_SHARE, LENGTH_SHARE, SCALE = 12, 25, 1_000_000_000

_KEPT = bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_TABLE = bytes(b if b in _KEPT else 0x20 for b in range(256)).lower()


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text: signs of more than one byte are never separators."""
    return text.translate(_TABLE).split()


def _texts(table: DataFrame, key: str) -> DataFrame:
    return table.select(F.col(key).cast("long").alias(key), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms array<binary>, times array<long>): one row per different item with any term."""
    def run(batches):
        for batch in batches:
            found = [Counter(terms_of(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id"), pa.array([list(c) for c in found], pa.list_(pa.binary())),
                 pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))], ["item_id", "terms", "times"])

    rows = _texts(items, "item_id").distinct().mapInArrow(run, "item_id long, terms array<binary>, times array<long>")
    return rows.where("size(terms) > 0")


def restricted_vectors(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(doc_id, n, terms array<int>, tfs array<int>): every document with any term; terms are places in ``vocabulary``."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # at most SET_TERMS terms

    def run(batches):
        place = {t: i for i, t in enumerate(sent.value)}
        for batch in batches:
            ns, terms, tfs, keep = [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                words = terms_of(text)
                if not words:
                    continue
                counted = [(place[t], tf) for t, tf in Counter(words).items() if t in place]
                keep.append(row)
                ns.append(len(words))
                terms.append([t for t, _ in counted])
                tfs.append([tf for _, tf in counted])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(keep, pa.int64())), pa.array(ns, pa.int64()), pa.array(terms, pa.list_(pa.int32())),
                 pa.array(tfs, pa.list_(pa.int32()))], ["doc_id", "n", "terms", "tfs"])

    return _texts(docs, "doc_id").mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def _summary(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(terms, matrix rows x terms of tf) of sparse rows."""
    lengths = [len(t) for t, _ in rows]
    terms, column = np.unique(np.concatenate([t for t, _ in rows]), return_inverse=True)
    matrix = np.zeros((len(rows), len(terms)), dtype=np.int64)
    matrix[np.repeat(np.arange(len(rows)), lengths), column] = np.concatenate([f for _, f in rows])
    return terms, matrix


class Tree:
    """FP-tree of (path, tfs, m, ids) vectors: branches with bounds, leaves with exact values.

    ``branches[i]`` is (terms, parts, children): ``parts`` holds for every child
    and term the score part tf and m allow at most; a child is a branch's number,
    or -1 - the vector's number.
    """

    def __init__(self, vectors: Iterable[tuple[np.ndarray, np.ndarray, int, int]]):
        alike: dict[tuple, list] = {}
        for path, tfs, m, doc in vectors:
            key = (path.astype(">i4").tobytes(), tfs.tobytes(), m)
            alike.setdefault(key, [path, tfs, m, []])[3].append(doc)
        self.vectors = [alike[k] for k in sorted(alike)]
        for v in self.vectors:
            v[3].sort(reverse=True)
        self.branches: list[tuple[np.ndarray, np.ndarray, list[int]]] = []
        self.root = self._build() if self.vectors else None

    def _shared(self) -> np.ndarray:
        """Length of the path that each vector shares with the one before."""
        out = np.zeros(len(self.vectors), dtype=np.int64)
        for i in range(1, len(self.vectors)):
            a, b = self.vectors[i - 1][0], self.vectors[i][0]
            k = min(len(a), len(b))
            differs = a[:k] != b[:k]
            out[i] = differs.argmax() if differs.any() else k
        return out

    def _build(self) -> int:
        shared = self._shared()
        order, todo = [], [(0, len(self.vectors), None)]
        while todo:  # ranges of vectors, parents before children; a caterpillar of paths needs no recursion
            lo, hi, parent = todo.pop()
            here = len(order)
            order.append((lo, hi, parent, []))
            if hi - lo > LEAF:
                inner = shared[lo + 1:hi]
                cuts = [lo, *(np.flatnonzero(inner == inner.min()) + lo + 1).tolist(), hi]
                todo.extend((a, b, here) for a, b in zip(cuts, cuts[1:], strict=False) if b - a > 1)
                order[here][3].extend(a for a, b in zip(cuts, cuts[1:], strict=False) if b - a == 1)
            else:
                order[here][3].extend(range(lo, hi))
        below: list[list] = [[] for _ in order]
        for here in range(len(order) - 1, -1, -1):
            lo, hi, parent, singles = order[here]
            rows = [(*self.vectors[i][:3], -1 - i) for i in singles] + below[here]
            terms, tf = _summary([r[:2] for r in rows])
            m = np.array([r[2] for r in rows], dtype=np.int64)
            parts = (SCALE * tf) // (1000 * tf + K1_SHARE * m[:, None])
            self.branches.append((terms, parts, [r[3] for r in rows]))
            if parent is not None:
                below[parent].append((terms, tf.max(axis=0), int(m.min()), len(self.branches) - 1))
            below[here] = []
        return len(self.branches) - 1

    def search(self, terms: np.ndarray, weights: np.ndarray, best: list[tuple[int, int]], k: int) -> int:
        """Enter this tree's documents into ``best``, a heap of (score, key of the id); returns the branches visited."""
        visited = 0
        todo = [(None, self.root)]
        while todo:
            bound, branch = todo.pop()
            least = best[0][0] if len(best) == k else 1
            if bound is not None and bound < least:
                continue
            visited += 1
            own, parts, children = self.branches[branch]
            at = np.searchsorted(own, terms)
            at[at == len(own)] = 0
            hit = own[at] == terms if len(own) else np.zeros(len(terms), bool)
            if not hit.any():
                continue
            scores = parts[:, at[hit]] @ weights[hit]
            ahead = np.flatnonzero(scores >= least)
            for i in ahead[np.argsort(scores[ahead], kind="stable")].tolist():
                if children[i] >= 0:
                    todo.append((int(scores[i]), children[i]))
            for i in ahead[np.argsort(-scores[ahead], kind="stable")].tolist():
                if children[i] < 0:
                    self._enter(best, int(scores[i]), self.vectors[-1 - children[i]][3], k)
        return visited

    @staticmethod
    def _enter(best: list[tuple[int, int]], score: int, keys: list[int], k: int) -> None:
        for key in keys:  # smallest doc_id first
            if len(best) < k:
                heapq.heappush(best, (score, key))
            elif (score, key) > best[0]:
                heapq.heapreplace(best, (score, key))
            else:
                return


_NULL = -(1 << 70)   # key of a null doc_id: after all others


def _trees(batches, rank: np.ndarray, n_docs: int, n_terms: int) -> Iterator[Tree]:
    """The documents of a task as trees."""
    held, size = [], 0
    for batch in batches:
        ids, ns = batch.column("doc_id").to_pylist(), batch.column("n").to_pylist()
        ends = batch.column("terms").value_lengths().to_numpy().cumsum()
        terms, tfs = rank[batch.column("terms").flatten().to_numpy()], batch.column("tfs").flatten().to_numpy()
        for i, end in enumerate(ends.tolist()):
            start = int(ends[i - 1]) if i else 0
            if start == end:
                continue
            order = np.argsort(terms[start:end])
            m = 100 - LENGTH_SHARE + (LENGTH_SHARE * ns[i] * n_docs) // n_terms
            held.append((terms[start:end][order], tfs[start:end][order], m, _NULL if ids[i] is None else -ids[i]))
            size += end - start
            if len(held) >= TREE_DOCS or size >= TREE_TERMS:
                yield Tree(held)
                held, size = [], 0
    if held:
        yield Tree(held)


def search_set(docs: DataFrame, items: list[tuple], k: int = TOP) -> DataFrame:
    """(item, item_id, doc_id, score): at most ``k`` rows an item and task; ``items`` are (item_id, terms, times)."""
    spark = docs.sparkSession
    vocabulary = sorted({t for _, terms, _ in items for t in terms})
    vectors = written(restricted_vectors(docs, vocabulary), "fp-vectors")
    n_docs, n_terms = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), dtype=np.int64)
    for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most the vocabulary
        df[r["t"]] = r["count"]
    order = np.argsort(-df, kind="stable")          # most frequent first
    rank = np.empty(len(order), dtype=np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()]
    place = {t: i for i, t in enumerate(vocabulary)}
    asked = []
    for item_id, terms, times in items:
        at = sorted((int(rank[place[t]]), weight[place[t]] * times[i]) for i, t in enumerate(terms) if df[place[t]])
        asked.append((item_id, np.array([a for a, _ in at], dtype=np.int32), np.array([w for _, w in at], dtype=np.int64)))
    sent = spark.sparkContext.broadcast((rank, asked))

    def run(batches):
        rank, asked = sent.value
        best = [[] for _ in asked]
        for tree in _trees(batches, rank, n_docs, n_terms):
            for i, (_, terms, weights) in enumerate(asked):
                if len(terms):
                    tree.search(terms, weights, best[i], k)
        for at in range(0, len(asked), 1000):
            rows = [(i, asked[i][0], None if key == _NULL else -key, score) for i in range(at, min(at + 1000, len(asked))) for score, key in best[i]]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(4)],
                                             ["item", "item_id", "doc_id", "score"])

    return vectors.mapInArrow(run, "item long, item_id long, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` highest-scoring documents with a score above 0."""
    asked = written(item_terms(items), "fp-items")
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    sets = max(1, math.ceil(total / SET_TERMS))
    dealt = asked.withColumn("set", F.pmod(F.xxhash64("item_id", "terms"), F.lit(sets)))
    found = None
    for s in range(sets):
        of_set = [(r.item_id, [bytes(t) for t in r.terms], r.times) for r in dealt.where(F.col("set") == s).collect()]
        if of_set:
            part = search_set(docs, of_set, k).withColumn("set", F.lit(s))
            found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    first = salted.withColumn("at", F.row_number().over(Window.partitionBy("set", "item", "salt").orderBy(*order))).where(F.col("at") <= k)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("set", "item").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE text IS NOT NULL),
c AS (SELECT *, len(terms) AS n FROM d WHERE len(terms) > 0),
s AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM c),
v AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(terms) AS term FROM c) GROUP BY rid, term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w
      FROM (SELECT term, count(*) AS df FROM v GROUP BY term), s),
i AS (SELECT row_number() OVER () AS iid, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT iid, term, count(*) AS q FROM (SELECT iid, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM i) GROUP BY iid, term),
r AS (SELECT iid, v.rid, sum(q * w * (({SCALE} * tf) // (1000 * tf + {K1_SHARE} * (100 - {LENGTH_SHARE} + ({LENGTH_SHARE} * n * n_docs) // n_terms))))::BIGINT AS score
      FROM q JOIN v USING (term) JOIN w USING (term) JOIN c ON c.rid = v.rid, s GROUP BY iid, v.rid)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, (row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank, doc_id, score
  FROM r JOIN i USING (iid) JOIN c USING (rid) WHERE score > 0) WHERE rank <= {TOP}"""
