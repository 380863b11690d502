"""The rule ledger against brute force, its SQL, and edge cases."""

import re
from collections import Counter

import duckdb
import pytest

from tickwise.llm import quality_rules as q
from tickwise.llm.queries import ORACLES, QUERIES
from tickwise.sources.files import scratch_path
from tools.oracle_check import digest

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
TEXTS = [None, "", " \n\t", "a b c a b c", "x y x y x y x", "one\ntwo\none\n\n \none", "Größe * & ÄÖ\x0b1\x0c2 !|<>",
         "w" * 2000, "     a", "é" * 10 + " " + "b" * 12, "a b c " * 3000]

WORDS = [chr(97 + i % 26) * 3 + chr(97 + i // 26) for i in range(60)]


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    times = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    inside = {j for i in range(len(words) - 2) if times[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(inside), len(lines), text.count("!"),
            sum(c in "0123456789" for c in text), max(map(len, words), default=0))


@pytest.mark.parametrize("text", TEXTS)
def test_measures_match_brute_force(text):
    assert q.text_measures(text or "") == brute(text)


def ledger_of(spark, rows):
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, failed int, n_words string")
    path = scratch_path(spark, "ledger")
    q.write_ledger(df, path)
    return q.read_ledger(spark, path)


def test_ledger_edges_and_verdicts(spark):
    rows = [*enumerate(TEXTS), (None, "a b"), (3, "a b c a b c"), (50, " ".join(WORDS))]
    got = q.report(ledger_of(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[0].failed & 1 and by[0].base_failed and not by[0].kept and by[0].n_words == 0
    assert by[10].n_repeat_words == 9000 and by[10].base_failed and not by[10].kept
    assert by[50].kept and by[50].failed == 0
    assert sum(r.doc_id == 3 for r in got) == 2
    assert q.report(ledger_of(spark, [])).count() == 0


def test_policies_and_ablations_match_row_by_row(spark):
    base = " ".join(WORDS)
    rows = [(0, base), (1, base + " #" * 30), (2, base.upper()), (3, base + "! " * 40), (4, base + "! " * 40 + "\na" * 9), (5, "few"),
            (6, base + "\nsame" * 30), (7, None)]
    ledger = ledger_of(spark, rows)
    failed = {r.doc_id: r.failed for r in ledger.collect()}
    names = [n for n, _ in q.RULES]

    def keeps(policy, bits, without=0):
        bits &= ~without
        return not bits & q.mask(policy.hard) and bin(bits & q.mask(policy.soft)).count("1") <= policy.allowed

    for policy in q.POLICIES:
        got = {r.doc_id: r.kept for r in q.apply_policy(ledger, policy).collect()}
        assert got == {i: keeps(policy, b) for i, b in failed.items()}
    found = {(r.policy, r.version, r.rule): r for r in q.ablations(ledger).collect()}
    assert len(found) == sum(len(p.hard) + len(p.soft) for p in q.POLICIES)
    for policy in q.POLICIES:
        for rule in (*policy.hard, *policy.soft):
            r, bit = found[policy.name, policy.version, rule], 1 << names.index(rule)
            also = 0
            for b in failed.values():
                also |= b if b & bit else 0
            assert (r.n_rows, r.kept, r.failed, r.kept_without, r.also_failed) == (
                len(rows), sum(keeps(policy, b) for b in failed.values()), sum(bool(b & bit) for b in failed.values()),
                sum(keeps(policy, b, bit) for b in failed.values()), also)
    assert q.ablations(ledger.limit(0)).count() == 0
    with pytest.raises(ValueError):
        q.mask(["no such rule"])


def test_query_matches_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    res = con.execute(ORACLES["op13_rule_ledger"])
    names = [d[0] for d in res.description]
    df = QUERIES["op13_rule_ledger"](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(names, res.fetchall())[0]


def test_labelled_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    path = scratch_path(spark, "ledger")
    q.write_ledger(docs, path)
    rows = q.apply_policy(q.read_ledger(spark, path)).join(labels, "doc_id").collect()
    assert not any(r.kept for r in rows if r.quality == 0)
    assert all(r.kept for r in rows if r.quality == 1 and r.n_words >= 50 and not r.base_failed)
