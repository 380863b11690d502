"""Fuzzy dedup: LCS exactness, brute-force agreement and the greedy invariants."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tickwise.operators import dedup as DD
from tickwise.operators._util import distributed_rank
from tickwise.sources import views

from .conftest import SF_SMALL


def lcs_dp(a, b):
    prev = [0] * (len(b) + 1)
    for ca in a:
        cur = [0]
        for j, cb in enumerate(b):
            cur.append(prev[j] + 1 if ca == cb else max(prev[j + 1], cur[j]))
        prev = cur
    return prev[-1]


def greedy_keep_first(titles):
    """Kept iff no earlier kept title of the day is similar."""
    kept = []
    for title in titles:
        kept.append(not any(k and DD.similar_py(before, title) for before, k in zip(titles, kept)))
    return kept


def test_lcs_matches_dp():
    rnd = random.Random(3)
    for _ in range(500):
        a = "".join(rnd.choice("abc台積") for _ in range(rnd.randint(0, 30)))
        b = "".join(rnd.choice("abc台積") for _ in range(rnd.randint(0, 30)))
        assert DD.lcs_length(a, b) == lcs_dp(a, b)
        assert DD.indel_ratio_py(a, b) == DD.indel_ratio_py(b, a)
    assert DD.indel_ratio_py("ab", "ba") == 50.0
    assert DD.indel_ratio_py("", "") == 100.0
    assert DD.indel_ratio_py("abc", "abc") == 100.0


@pytest.mark.parametrize("hot", [3, DD.HOT_ROWS])
def test_prefix_filter_is_exact_on_random_titles(spark, monkeypatch, hot):
    monkeypatch.setattr(DD, "HOT_ROWS", hot)  # 3: nearly every token is cut into parts
    rnd = random.Random(7)
    base = ["晶片廠法說會營收創新高", "半導體設備出貨", "外資賣超晶片廠", "AI伺服器需求強勁"]
    titles = []
    for i in range(120):
        t = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 3)):
            op = rnd.random()
            pos = rnd.randrange(len(t) + 1)
            if op < 0.4 and t:
                t.pop(min(pos, len(t) - 1))
            elif op < 0.8:
                t.insert(pos, rnd.choice("的了是在"))
            else:
                t = t[: max(1, len(t) // 2)]
        titles.append("".join(t))
    keys = sorted(set(titles))
    nodes = spark.createDataFrame([("d", i + 1, k, len(k)) for i, k in enumerate(keys)], "_day STRING, _node INT, _norm STRING, _len INT")
    found = DD.similar_pairs(nodes).collect()
    got = {(r.lo, r.hi) for r in found}
    assert len(found) == len(got)
    exp = {(i + 1, j + 1) for i, j in itertools.combinations(range(len(keys)), 2) if DD.similar_py(keys[i], keys[j])}
    assert got == exp


def test_fuzzy_dedup_matches_brute_force_and_invariants(spark):
    n = views.news(spark, SF_SMALL)
    flagged = DD.fuzzy_dedup(n, with_flag=True).withColumn("norm", DD.normalize_title(F.col("title"))).collect()
    by_day = {}
    for r in flagged:
        by_day.setdefault(str(r.date), []).append(r)
    for day, rows in by_day.items():
        rows.sort(key=lambda r: (r.stock_id, r.date, r.id))
        expected = greedy_keep_first([r.norm for r in rows])
        assert [r.kept for r in rows] == expected, day
        kept = [r for r in rows if r.kept]
        for a, b in itertools.combinations(kept, 2):
            assert not DD.similar_py(a.norm, b.norm)
        for i, r in enumerate(rows):
            if not r.kept:
                assert any(k.kept and DD.similar_py(k.norm, r.norm) for k in rows[:i])
    # idempotent
    once = DD.fuzzy_dedup(n)
    twice = DD.fuzzy_dedup(once)
    assert once.count() == twice.count()


def test_dedup_stats_totals(spark):
    st = DD.dedup_stats(DD.fuzzy_dedup(views.news(spark, SF_SMALL), with_flag=True)).collect()
    total = [r for r in st if r.day is None][0]
    assert total.original == 200 and total.kept + total.removed == 200


def test_rank_of_a_hot_day_is_spread_and_exact(spark):
    rnd = random.Random(1)
    rows = [("hot" if i % 3 else rnd.choice(["a", "b", None]), rnd.choice([None, *range(40)]), rnd.randint(0, 9), i) for i in range(3000)]
    rows += [("hot", 7, 7, 5000)] * 50 + [("same", None, None, None)] * 20
    df = spark.createDataFrame(rows, "day string, k long, j long, id long").repartition(5)
    got = distributed_rank(df, ["day"], ["k", "j", "id"])
    ranks = {}
    for r in got.collect():
        ranks.setdefault(r.day, []).append((r._rn, ((r.k is not None, r.k or 0), (r.j is not None, r.j or 0), (r.id is not None, r.id or 0))))
    assert sum(map(len, ranks.values())) == len(rows)
    for found in ranks.values():
        found.sort()
        assert [n for n, _ in found] == list(range(1, len(found) + 1))
        assert [k for _, k in found] == sorted(k for _, k in found)
    assert distributed_rank(df.limit(0), ["day"], ["k"]).count() == 0


def test_a_hot_day_fills_many_ranges(spark):
    df = spark.range(200000).selectExpr("if(id % 3 = 0, 'hot', cast(id as string)) AS day", "id % 7 AS k", "id")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = distributed_rank(df, ["day"], ["k", "id"])
        assert ranked.filter("day = 'hot'").agg(F.max("_rn"), F.countDistinct("_rn")).first()[:] == (66667, 66667)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_rows_without_a_date_are_kept_and_deduplicated(spark):
    df = spark.createDataFrame([(1, "s", None, "some long title"), (2, "s", None, "some long title!"), (3, "s", None, None), (4, "s", "2024-01-01", "")],
                               "id long, stock_id string, date string, title string")
    assert sorted(r.id for r in DD.fuzzy_dedup(df).collect()) == [1, 3, 4]


def edited(rnd, text, alphabet, share):
    t = list(text)
    for _ in range(rnd.randint(0, max(1, int(len(t) * share)))):
        at = rnd.randrange(len(t) + 1)
        if rnd.random() < 0.5 and len(t) > 1:
            t.pop(min(at, len(t) - 1))
        else:
            t.insert(at, rnd.choice(alphabet))
    return "".join(t)


def test_blocks_of_keys_are_compared_exactly(monkeypatch):
    from tickwise.operators import lcs

    rnd = random.Random(5)
    for trial in range(24):
        monkeypatch.setattr(lcs, "PAIRS", (3, 50, 4096)[trial % 3])
        monkeypatch.setattr(lcs, "CELLS", (200, 5000, 2_000_000)[trial // 3 % 3])
        threshold = rnd.choice([60, 85, 95])
        alphabet = rnd.choice(["ab", "abcdefghij", "台積電abcdefghijklmnopqrst😀"])
        base = ["".join(rnd.choice(alphabet) for _ in range(rnd.choice([1, 5, 63, 64, 65, 130, 300]))) for _ in range(4)]
        keys = sorted({edited(rnd, rnd.choice(base), alphabet, 0.35) for _ in range(50)}, key=len)
        want = {(i, j): DD.lcs_length(keys[i], keys[j]) for i, j in itertools.combinations(range(len(keys)), 2)
                if DD.similar_py(keys[i], keys[j], threshold)}
        assert {(i, j): n for i, j, n in zip(*map(list, lcs.similar_keys(keys, None, threshold)))} == want
        half = len(keys) // 2
        got = {(i, j + half): n for i, j, n in zip(*map(list, lcs.similar_keys(keys[:half], keys[half:], threshold)))}
        assert got == {pair: n for pair, n in want.items() if pair[0] < half <= pair[1]}


def test_keys_of_the_same_letters_go_by_parts(monkeypatch):
    """Keys of the same letters in another order pass every count: all their pairs were aligned over the whole keys."""
    from tickwise.operators import lcs

    rnd = random.Random(11)
    letters = [c for c in "abcdefghijklmnopqrst" for _ in range(8)]
    keys = ["".join(rnd.sample(letters, len(letters))) for _ in range(60)]
    keys = sorted({*keys, *(edited(rnd, k, "abcdefghijklmnopqrst", 0.05) for k in keys[:20])}, key=len)
    want = {(i, j): DD.lcs_length(keys[i], keys[j]) for i, j in itertools.combinations(range(len(keys)), 2) if DD.similar_py(keys[i], keys[j])}
    whole, align = [], lcs._aligned

    def aligned(held, *pairs):
        if isinstance(held, lcs.Keys):
            whole.append(sum(y.size for _, y in pairs[0]) if isinstance(pairs[0], list) else pairs[0].size)
        return align(held, *pairs)

    monkeypatch.setattr(lcs, "_aligned", aligned)
    assert {(i, j): n for i, j, n in zip(*map(list, lcs.similar_keys(keys, None, 85)))} == want
    assert len(want) >= 15 and sum(whole) < 2 * len(want)


@pytest.mark.parametrize("few", [0, 32])
@pytest.mark.parametrize("parts", [1, 4, 8])
def test_every_way_of_aligning_is_exact(monkeypatch, few, parts):
    from tickwise.operators import lcs

    rnd = random.Random(parts)
    monkeypatch.setattr(lcs, "FEW", few)
    monkeypatch.setattr(lcs, "PARTS", parts)
    for trial in range(12):
        monkeypatch.setattr(lcs, "WORDS", (0, 1, 4)[trial % 3])
        monkeypatch.setattr(lcs, "PAIRS", (40, 4096)[trial % 2])
        threshold = rnd.choice([30, 60, 85, 100])
        alphabet = rnd.choice(["a", "ab", "abcdefghij", [chr(0x4E00 + n) for n in range(900)] + ["\U0001f600", "\ud800"]])
        base = ["".join(rnd.choice(alphabet) for _ in range(rnd.choice([1, 5, 64, 130, 400]))) for _ in range(4)]
        keys = sorted({edited(rnd, rnd.choice(base), alphabet, 0.35) for _ in range(40)}, key=len)
        want = {(i, j): DD.lcs_length(keys[i], keys[j]) for i, j in itertools.combinations(range(len(keys)), 2)
                if DD.similar_py(keys[i], keys[j], threshold)}
        assert {(i, j): n for i, j, n in zip(*map(list, lcs.similar_keys(keys, None, threshold)))} == want
    # counts beyond 16 bits
    keys = ["ab" * 33000, "ab" * 33000 + "c", "ba" * 20000 + "c" * 30000]
    assert [list(map(int, p)) for p in lcs.similar_keys(keys, None, 85)] == [[0], [1], [66000]]


def test_only_keys_travel_and_a_hot_day_is_cut(spark, monkeypatch):
    """Keys of the same letters share every token: as candidate pairs they were 300 * 299 / 2 rows."""
    monkeypatch.setattr(DD, "HOT_ROWS", 20)
    rnd = random.Random(2)
    keys = sorted({"".join(rnd.sample("abcdefghijklmnopqrst", 20)) for _ in range(300)})
    nodes = spark.createDataFrame([("d", i + 1, k, len(k)) for i, k in enumerate(keys)] + [("d", 400, "a" * 200, 200), (None, 1, keys[0], 20)],
                                  "_day STRING, _node INT, _norm STRING, _len INT")
    held = DD.block_pairs(nodes)
    groups = held.groupBy("_day", "_i", "_j").count().collect()
    assert max(g["count"] for g in groups) <= 2 * 20 and sum(g["count"] for g in groups) < 301 * 20
    assert held.filter("_node = 400").filter("_i <> _j").count() <= 1
    plan = DD.similar_pairs(nodes)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan and "Deduplicate" not in plan
    want = {(i + 1, j + 1) for i, j in itertools.combinations(range(len(keys)), 2) if DD.similar_py(keys[i], keys[j])}
    assert {(r.lo, r.hi) for r in DD.similar_pairs(nodes).collect()} == want


def test_rank_without_the_texts(spark):
    df = spark.createDataFrame([("d", i % 3, f"text {i}") for i in range(60)], "day string, k long, text string")
    whole = {(r.k, r.text): r._rn for r in distributed_rank(df, ["day"], ["k"]).collect()}
    slim = df.withColumn("h", F.xxhash64(*df.columns)).select("day", "k", F.substring("text", 6, 2).alias("n"), "h")
    got = distributed_rank(slim, ["day"], ["k"], tie="h")
    assert got.columns == ["day", "k", "n", "_rn"]
    assert {(r.k, f"text {r.n}"): r._rn for r in got.collect()} == whole
