r"""Quality rules kept in a bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps the measurements
and one ``failed`` number per row whose bit i is set where rule i fails.
Policies are versioned masks over those bits: a row is kept if it fails no hard
rule and at most ``allowed`` soft ones.  Applying another policy, or asking what
a rule costs, reads the ledger alone: ablations first count the rows of each bit
pattern (at most 2^rules of them, combined before the shuffle) and then work on
patterns with bitwise operations.

Measurements of a text: words are ``[^\x20\x09-\x0D]+``; lines are cut at \n and
count if they hold a word.  Whole texts are measured.  A null or empty text has
no words, all its measurements are zero and it fails ``few_words``; a null
doc_id stays null; repeated rows are rows of their own; an empty table gives an
empty ledger; further columns are ignored.  Rules compare whole numbers only, so
nothing depends on rounding.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Measurements of a text, in the ledger's order.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaims", "n_digits",
            "max_word", "n_letters", "n_upper")

#: (name, condition under which the rule fails); the place in this list is the rule's bit, so new rules go to the end.
RULES = [
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 10 * n_words"),
    ("capitals", "100 * n_upper > 40 * n_letters"),
    ("few_letters", "100 * n_letters < 50 * word_chars"),
    ("digits", "100 * n_digits > 30 * word_chars"),
    ("repeated_lines", "100 * n_dup_lines > 40 * n_lines"),
    ("exclamations", "100 * n_exclaims > 30 * n_words"),
    ("short_words", "word_chars < 3 * n_words"),
    ("long_words", "word_chars > 12 * n_words"),
    ("giant_word", "max_word > 1000"),
]
BASE = ("few_words", "repeated_windows")
LEDGER = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES) + ", failed long"

_BREAKS = "\x20\x09\x0a\x0b\x0c\x0d"
_SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Policy:
    """A version of what is kept: no failure among ``hard``, at most ``allowed`` among ``soft``."""
    name: str
    version: int
    hard: tuple[str, ...]
    soft: tuple[str, ...] = ()
    allowed: int = 0


POLICIES = [
    Policy("base", 1, BASE),
    Policy("standard", 1, (*BASE, "symbols", "capitals")),
    Policy("standard", 2, (*BASE, "symbols", "capitals", "few_letters", "giant_word"),
           ("digits", "repeated_lines", "exclamations", "short_words", "long_words"), 1),
]
CURRENT = POLICIES[-1]


def mask(rules: Sequence[str]) -> int:
    """Bits of the rules named; an unknown name is an error."""
    names = [name for name, _ in RULES]
    return sum(1 << names.index(r) for r in set(rules))


def repeated_words(words: Sequence[bytes]) -> int:
    """Words that lie in a window of three which the text holds at least twice."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    times = Counter(windows)
    if len(times) == len(windows):
        return 0
    found = end = 0
    for i, window in enumerate(windows):
        if times[window] > 1:
            found += i + 3 - max(i, end)
            end = i + 3
    return found


def text_measures(text: str) -> tuple[int, ...]:
    """All measurements but the letter counts."""
    words = text.encode().split()  # bytes split at ASCII white space only
    lines = [line for line in text.split("\n") if line.strip(_BREAKS)]
    return (len(words), len(text) - sum(map(text.count, _BREAKS)), sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines)),
            repeated_words(words), len(lines), text.count("!"), sum(map(text.count, "0123456789")),
            max((len(w.decode()) for w in _longest(words)), default=0))


def _longest(words: Sequence[bytes]) -> set[bytes]:
    """The words that can have the most characters: a character takes one to four bytes."""
    most = max(map(len, words), default=0)
    return {w for w in words if 4 * len(w) >= most}


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, measurements): one row per row of ``docs`` (doc_id, text)."""
    names = MEASURES[:-2]

    def run(batches):
        for batch in batches:
            found = list(zip(*map(text_measures, batch.column("text").to_pylist()), strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in found], batch.column("n_letters"), batch.column("n_upper")],
                ["doc_id", *names, "n_letters", "n_upper"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
                       F.regexp_count(text, F.lit(r"\p{L}")).cast("long").alias("n_letters"),
                       F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))


def failure_bits() -> Column:
    """The rules' failures of a row of measurements as one number."""
    return sum((F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, rule) in enumerate(RULES)),
               F.lit(0).cast("long"))


def write_ledger(docs: DataFrame, path: str) -> None:
    """Evaluate every rule on every row of ``docs`` and write the ledger under ``path`` (a folder all executors share)."""
    measure(docs).withColumn("failed", failure_bits()).write.mode("overwrite").parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, measurements, failed)."""
    return spark.read.schema(LEDGER).parquet(path)


def _fails(failed: Column, bits: int) -> Column:
    return failed.bitwiseAND(F.lit(bits)) != 0


def keeps(policy: Policy, failed: Column, leave_out: Column | None = None) -> Column:
    """Whether the policy keeps a row with these failure bits; the bits of ``leave_out`` do not count."""
    if leave_out is not None:
        failed = failed.bitwiseAND(F.bitwise_not(leave_out))
    soft = F.bit_count(failed.bitwiseAND(F.lit(mask(policy.soft))))
    return ~_fails(failed, mask(policy.hard)) & (soft <= policy.allowed)


def apply_policy(ledger: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """The ledger's rows with the base rules' verdict, the policy's verdict and its version."""
    failed = F.col("failed")
    base = _fails(failed, mask(BASE))
    return ledger.withColumns({"base_failed": base, "kept": ~base & keeps(policy, failed),
                               "policy": F.lit(f"{policy.name}-{policy.version}")})


def ablations(ledger: DataFrame, policies: Sequence[Policy] = tuple(POLICIES)) -> DataFrame:
    """What each rule of each policy does: one row per policy and rule.

    n_rows, kept (by the policy), failed (rows that fail the rule), kept_without
    (kept if the rule did not count), also_failed (bits of all rules that some
    row failing this rule fails too).  Rows are counted per bit pattern first.
    An empty ledger gives no rows.
    """
    patterns = ledger.groupBy("failed").agg(F.count("*").alias("n"))
    parts = []
    failed = F.col("failed")
    for p in policies:
        rules = [F.struct(F.lit(name).alias("rule"), F.lit(mask([name])).cast("long").alias("bit")) for name in (*p.hard, *p.soft)]
        rows = patterns.select("*", F.inline(F.array(*rules)))
        bit = failed.bitwiseAND(F.col("bit")) != 0
        parts.append(rows.groupBy("rule", "bit").agg(
            F.sum("n").alias("n_rows"), F.sum(F.when(keeps(p, failed), F.col("n")).otherwise(0)).alias("kept"),
            F.sum(F.when(bit, F.col("n")).otherwise(0)).alias("failed"),
            F.sum(F.when(keeps(p, failed, F.col("bit")), F.col("n")).otherwise(0)).alias("kept_without"),
            F.coalesce(F.bit_or(F.when(bit, failed)), F.lit(0).cast("long")).alias("also_failed"),
        ).withColumns({"policy": F.lit(p.name), "version": F.lit(p.version)}))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("policy", "version", "rule", "n_rows", "kept", "failed", "kept_without", "also_failed")


def report(ledger: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """The registered query's columns."""
    return apply_policy(ledger, policy).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                               "base_failed", "kept", "failed")


def oracle(policy: Policy = CURRENT) -> str:
    """The same report as one DuckDB statement: windows as rows, rules on the counted columns."""
    bits = " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, (_, rule) in enumerate(RULES))
    return rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM t),
w AS (SELECT rid, unnest(range(1, len(words) - 1)) AS i, words FROM p WHERE len(words) >= 3),
v AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i], words[i + 1], words[i + 2]) AS times FROM w),
r AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM v WHERE times > 1) GROUP BY rid),
m AS (SELECT p.rid, doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        coalesce(r.n, 0) AS n_repeat_words, len(lines) AS n_lines, len(regexp_extract_all(text, '!')) AS n_exclaims,
        len(regexp_extract_all(text, '[0-9]')) AS n_digits,
        coalesce(list_max(list_transform(words, lambda x: length(x))), 0) AS max_word,
        len(regexp_extract_all(text, '\p{{L}}')) AS n_letters, len(regexp_extract_all(text, '\p{{Lu}}')) AS n_upper
      FROM p LEFT JOIN r ON p.rid = r.rid),
f AS (SELECT *, ({bits})::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & {mask(BASE)}) <> 0 AS base_failed,
  (failed & {mask(BASE)}) = 0 AND (failed & {mask(policy.hard)}) = 0 AND bit_count(failed & {mask(policy.soft)}) <= {policy.allowed} AS kept,
  failed FROM f"""
