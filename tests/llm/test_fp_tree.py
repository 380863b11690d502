"""FP-tree search against brute force, its SQL, and edge cases."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tickwise.llm import fp_tree
from tickwise.llm.queries import ORACLES, QUERIES
from tools.oracle_check import digest

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
DOCS = "doc_id long, text string, item_id string, score int"
ITEMS = "item_id long, text string, doc_id string, rank int"


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, k):
    kept = [(i, Counter(t), len(t)) for i, t in ((i, terms(x)) for i, x in docs) if t]
    n_docs, n_terms = len(kept), sum(n for _, _, n in kept)
    df = Counter(t for _, c, _ in kept for t in c)
    out = []
    for item, text in set(items):
        asked = Counter(terms(text))
        scores = []
        for doc, c, n in kept:
            m = 75 + (25 * n * n_docs) // n_terms
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 12 * m))
                    for t, q in asked.items() if c[t])
            if s > 0:
                scores.append((-s, doc is None, doc or 0))
        out += [(item, r, None if null else doc, -s) for r, (s, null, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def test_terms_are_the_contracts():
    text = "Ab\x00c-D\x7fé_É ÀB€9[z]{q}　\x85 x" + "".join(map(chr, range(0x250)))
    assert [t.decode() for t in fp_tree.terms_of(text.encode())] == terms(text)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    text = [" ".join(words[min(int(rng.expovariate(0.08)), 59)] for _ in range(rng.choice([0, 3, 9, 40, 200]))) for _ in range(n)]
    copies = [text[7]] * (n // 3)
    return [*enumerate(text + copies), (5, text[6]), (None, text[9]), (900001, None), (900002, "... !"), (900003, "W1 w1 W1 É"), (900003, "W1 w1 W1 É")]


@pytest.mark.parametrize("small", [True, False])
def test_ranked_search_matches_brute_force(spark, monkeypatch, small):
    if small:  # many trees, deep branches, several sets of items
        for name, value in (("TREE_DOCS", 40), ("LEAF", 3), ("SET_TERMS", 15)):
            monkeypatch.setattr(fp_tree, name, value)
    docs = corpus(3, 300)
    items = [(1, "w1 w2 w3 w40 w50"), (1, "w1 w2 w3 w40 w50"), (1, "w59 w58"), (2, docs[7][1]), (3, None), (4, "!"), (None, "W1 w1 é É"),
             (5, "unseen words w30"), (6, "nothing known"), (7, " ".join(f"w{i}" for i in range(60)))]
    found = fp_tree.ranked_search(spark.createDataFrame([(*r, "x", 1) for r in docs], DOCS).repartition(3),
                                  spark.createDataFrame([(*r, "y", 2) for r in items], ITEMS), 12)
    assert rows_of(found) == brute(docs, items, 12)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b", "", 0)], DOCS), spark.createDataFrame([(1, "a", "", 0)], ITEMS)
    assert fp_tree.ranked_search(docs.limit(0), items).count() == 0
    none = fp_tree.ranked_search(docs, items.limit(0))
    assert none.count() == 0 and none.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


def test_branches_bound_and_prune():
    rng = np.random.default_rng(4)
    vectors = []
    for i in range(3000):
        group = i % 30
        path = np.unique(np.concatenate([np.arange(group, group + 3), rng.integers(40, 400, 5)])).astype(np.int32)
        vectors.append((path, rng.integers(1, 4, len(path)).astype(np.int32), 100 + i % 7, -i))
    tree = fp_tree.Tree(vectors)
    assert sum(len(v[3]) for v in tree.vectors) == 3000
    asked, weights = np.array([10, 11, 12], dtype=np.int32), np.array([500, 600, 700])
    best = []
    visited = tree.search(asked, weights, best, 20)
    score = {}
    for path, tfs, m, key in vectors:
        score[key] = sum(int(w) * (10 ** 9 * int(tf) // (1000 * int(tf) + 12 * m)) for t, w in zip(asked, weights, strict=True)
                         for tf in tfs[path == t])
    assert sorted(best, reverse=True) == sorted(((s, k) for k, s in score.items()), reverse=True)[:20]
    assert visited < len(tree.branches) / 4


def test_deep_paths_need_no_recursion():
    vectors = [(np.arange(i + 1, dtype=np.int32), np.ones(i + 1, dtype=np.int32), 100, -i) for i in range(1500)]
    best = []
    fp_tree.Tree(vectors).search(np.array([1499], dtype=np.int32), np.array([9]), best, 5)
    assert [k for _, k in best] == [-1499]


def test_query_matches_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    res = con.execute(ORACLES["op11_fp_tree"])
    names = [d[0] for d in res.description]
    df = QUERIES["op11_fp_tree"](spark, sf)
    assert sorted(df.columns) == sorted(names)
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(names, res.fetchall())[0]
