r"""Mixing sources to target weights by fixed-length blocks.

The words of a source, in doc_id order, are packed into blocks of ``BLOCK``
words (the last one may be shorter).  A source of S words with target T gives
round(T) words: whole passes over its blocks, then the first blocks of one more
pass, each pass in an order of its own, a pseudorandom permutation of the block
numbers (a keyed Feistel network, walked until it falls inside the range).  So a
block, and hence a document, is used at most ceil(T / S) times.

Output shards hold ``SHARD`` slots.  Each shard draws how many of its slots go
to each source from a multinomial with the target weights, seeded by the
shard's number.  The running count over the shards maps a slot to the next
index of its source; draws beyond a source's blocks are dealt to the sources
whose draws fell short, so all quotas are met exactly.  Index to block is the
permutation, block to words is a join.  Reruns agree, whatever the partitioning.

Targets: sources by code point, null last, have the weights 3, 1, 2, repeating,
and share ``SHARE`` times all words; no target exceeds ``REPEAT`` times its
source, the excess goes to the others by weight.

Null text has size 0; documents of size 0 are returned with taken 0; repeated
rows and equal ids are separate documents; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prefix_sum, row_key, written

BLOCK = 1024                 # words of a block
SHARD = 256                  # slots of an output shard
WEIGHTS = (3, 1, 2)
SHARE = 1.5                  # words of the mix over words of all sources
REPEAT = 2                   # a source gives at most so many times its words
SEED = 7
MAX_SOURCES = 1_000_000      # the draw needs all sources' weights in a task: more are refused
WORD = r"[^\x20\x09-\x0D]+"
_CHUNK = 4096                # ids of a chunk of the running sums


def _round(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    """64-bit mixing of x under key."""
    x = (x ^ key) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def permute(i: np.ndarray, n: np.ndarray, key: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Pseudorandom permutation of 0..n-1 under key, elementwise; ``inverse`` undoes it."""
    i, n, key = (np.asarray(v, dtype=np.uint64).copy() for v in (i, n, key))
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2).astype(np.float64))).astype(np.uint64) + np.uint64(1)) // np.uint64(2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    todo = np.arange(i.size)
    while todo.size:
        h, m, k, x = half[todo], mask[todo], key[todo], i[todo]
        left, right = x >> h, x & m
        for r in range(4):
            if inverse:
                left, right = right ^ (_round(left, k + np.uint64(3 - r)) & m), left
            else:
                left, right = right, left ^ (_round(right, k + np.uint64(r)) & m)
        i[todo] = (left << h) | right
        todo = todo[i[todo] >= n[todo]]
    return i.astype(np.int64)


def _keys(seed: int, sid: np.ndarray, epoch: np.ndarray) -> np.ndarray:
    base = np.asarray(sid, np.uint64) * np.uint64(1_000_003) + np.asarray(epoch, np.uint64) + np.uint64(seed << 40)
    return _round(base, np.uint64(0x51ED270B))


def source_targets(sized: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """One row per source: sid, source_size, target, and its plan of passes (n_blocks, whole, part_words, part_slots, quota)."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))  # over the sources, not the documents
    sources = sources.withColumn("sid", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("sid") % len(WEIGHTS) + 1)
    sources = sources.withColumn("w", weight).withColumn("cap", REPEAT * F.col("source_size"))
    # sources sorted by cap / weight: those before the first that stays under its cap are capped
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    before, after = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.partitionBy(F.lit(0))
    level = (SHARE * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(after)
    sources = sources.withColumn("level", level)
    fits = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))
    sources = sources.withColumn("level", F.max(fits).over(all_rows))
    sources = sources.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("w"), F.col("cap"))))
    s = F.greatest("source_size", F.lit(1))
    take = F.round("target").cast("long")
    sources = (sources.withColumn("n_blocks", F.ceil(F.col("source_size") / block).cast("long"))
               .withColumn("whole", F.floor(take / s).cast("long"))
               .withColumn("part_words", take - F.col("whole") * s)
               .withColumn("last_len", F.col("source_size") - (F.col("n_blocks") - 1) * block))

    @F.pandas_udf("long")
    def short_at(sid: pd.Series, n: pd.Series, epoch: pd.Series) -> pd.Series:
        m = np.maximum(n.to_numpy(), 1)
        return pd.Series(permute(m - 1, m, _keys(seed, sid.to_numpy(), epoch.to_numpy()), inverse=True))

    sources = sources.withColumn("short_at", short_at("sid", "n_blocks", "whole"))
    plain = F.ceil(F.col("part_words") / block)
    part = F.when(F.col("short_at") < plain, 1 + F.greatest(F.ceil((F.col("part_words") - F.col("last_len")) / block), F.lit(0))).otherwise(plain)
    sources = sources.withColumn("part_slots", part.cast("long"))
    return sources.withColumn("quota", F.col("whole") * F.col("n_blocks") + F.col("part_slots")).select(
        "source", "sid", "source_size", "target", "n_blocks", "whole", "part_words", "part_slots", "last_len", "short_at", "quota")


def draw_slots(sources: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """(shard, sid, epoch, block, words): one row per slot; ``words`` is how many of the block's first words it takes."""
    spark = sources.sparkSession
    known = sources.select("sid", "quota").where("quota > 0").limit(MAX_SOURCES + 1).toPandas()
    if len(known) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; group rare ones first")
    sids, quota = known["sid"].to_numpy(np.int64), known["quota"].to_numpy(np.int64)
    order = np.argsort(sids)
    sids, quota, total = sids[order], quota[order], int(quota.sum())

    def draw(batches):
        p = quota / max(total, 1)
        for pdf in batches:
            for k in pdf["shard"]:
                n = min(shard, total - int(k) * shard)
                counts = np.random.default_rng([seed, int(k)]).multinomial(n, p)
                at = np.flatnonzero(counts)
                yield pd.DataFrame({"shard": k, "sid": sids[at], "n": counts[at]})

    shards = spark.range(-(-total // shard)).select(F.col("id").alias("shard"))
    draws = written(shards.mapInPandas(draw, "shard long, sid long, n long"), "mix-draws")
    chunk = F.floor(F.col("shard") / _CHUNK)
    placed = prefix_sum(draws, ["sid"], [F.col("shard")], chunk, "n", "start").join(sources.select("sid", "quota"), "sid")
    placed = written(placed, "mix-placed")
    kept = placed.withColumn("end", F.least(F.col("start") + F.col("n"), F.col("quota"))).where("end > start").select(
        "shard", "sid", F.explode(F.sequence("start", F.col("end") - 1)).alias("i"))
    # draws beyond a quota are numbered through, and so are the indices that no draw reached
    over = placed.withColumn("extra", F.least(F.col("n"), F.col("start") + F.col("n") - F.col("quota"))).where("extra > 0")
    over = prefix_sum(over.withColumn("all", F.lit(0)), ["all"], [F.col("shard"), F.col("sid")], chunk, "extra", "base")
    over = over.select("shard", F.explode(F.sequence("base", F.col("base") + F.col("extra") - 1)).alias("g"))
    drawn = placed.groupBy("sid").agg(F.sum("n").alias("drawn"))
    short = (sources.select("sid", "quota").join(drawn, "sid", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
             .where("quota > drawn").withColumn("lack", F.col("quota") - F.col("drawn")))
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)  # over the sources
    short = short.withColumn("base", F.coalesce(F.sum("lack").over(upto), F.lit(0))).select(
        "sid", F.posexplode(F.sequence("drawn", F.col("quota") - 1)).alias("k", "i"), "base").select(
        "sid", "i", (F.col("base") + F.col("k")).alias("g"))
    slots = kept.unionByName(over.join(short, "g").select("shard", "sid", "i"))
    slots = slots.join(sources.drop("source", "quota", "source_size", "target"), "sid")
    slots = slots.withColumn("epoch", F.floor(F.col("i") / F.col("n_blocks"))).withColumn("j", F.col("i") % F.col("n_blocks"))

    @F.pandas_udf("long")
    def block_of(j: pd.Series, n: pd.Series, sid: pd.Series, epoch: pd.Series) -> pd.Series:
        return pd.Series(permute(j.to_numpy(), n.to_numpy(), _keys(seed, sid.to_numpy(), epoch.to_numpy())))

    slots = slots.withColumn("block", block_of("j", "n_blocks", "sid", "epoch"))
    length = F.when(F.col("block") == F.col("n_blocks") - 1, F.col("last_len")).otherwise(F.lit(block))
    last = (F.col("epoch") == F.col("whole")) & (F.col("j") == F.col("part_slots") - 1)
    before = (F.col("part_slots") - 1) * block - F.when(F.col("short_at") < F.col("part_slots") - 1, block - F.col("last_len")).otherwise(0)
    words = F.when(last, F.col("part_words") - before).otherwise(length)
    return slots.select("shard", "sid", F.col("epoch").cast("long").alias("epoch"), "block", words.cast("long").alias("words"))


def _sized(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       size.alias("size"), row_key(docs).alias("key"))


def plan_mix(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with offsets, sources, uses): ``uses`` has a row per document, pass and block it shares with a slot."""
    sized = written(_sized(docs), "mix-sizes")
    sources = written(source_targets(sized, block, seed), "mix-sources")
    slots = written(draw_slots(sources, block, shard, seed), "mix-slots")
    chunk = F.coalesce(F.floor(F.col("doc_id") / _CHUNK), F.lit(-(1 << 52)))
    placed = prefix_sum(sized, ["source"], [F.asc_nulls_first("doc_id"), F.col("size"), F.col("key")], chunk, "size", "at")
    small = sources.select(F.col("source").alias("_s"), "sid", "source_size", "target")
    placed = placed.join(small, placed["source"].eqNullSafe(small["_s"])).drop("_s")
    placed = written(placed, "mix-placed-docs")
    pieces = placed.where("size > 0").select(
        "doc_id", "key", "sid", "at", "size",
        F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))).alias("block"))
    first = F.greatest(F.col("at") - F.col("block") * block, F.lit(0))        # in words of the block
    end = F.least(F.col("at") + F.col("size") - F.col("block") * block, F.col("words"))
    uses = (pieces.join(slots, ["sid", "block"]).withColumn("n", end - first).where("n > 0")
            .withColumn("from", F.col("block") * block + first - F.col("at")))
    return placed, sources, uses.select("doc_id", "key", "sid", "at", "size", "shard", "epoch", "block", "from", "n")


def mix_report(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken): one row per document."""
    placed, _, uses = plan_mix(docs, block, shard, seed)
    taken = uses.groupBy("sid", "at").agg(F.sum("n").alias("taken"))  # a non-empty document is known by its offset
    some = placed.where("size > 0").join(taken, ["sid", "at"], "left")
    none = placed.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    cols = ["doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")]
    return some.select(*cols).unionByName(none.select(*cols))


_WORDS = re.compile(WORD)


def cut_words(text: str, spans: list) -> str:
    """The text of word spans (from, n), each from its first word to its last; adjoining spans are one."""
    joined: list[list[int]] = []
    for start, n in sorted((s["from"], s["n"]) for s in spans):
        if joined and joined[-1][1] == start:
            joined[-1][1] = start + n
        else:
            joined.append([start, start + n])
    at = [(m.start(), m.end()) for m in _WORDS.finditer(text)]
    if joined == [[0, len(at)]]:
        return text
    return "\n".join(text[at[a][0]:at[b - 1][1]] for a, b in joined)


def mix_documents(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """The mix as documents: per document and pass one row whose text is the words taken in that pass.

    A text taken whole stays as it is; of others the taken word spans are kept,
    joined by a line end.  All further columns are copied; ``n_chars``, where
    there is one, is the new length.  Documents of which nothing is taken go.
    """
    _, _, uses = plan_mix(docs, block, shard, seed)
    passes = (uses.groupBy("key", "at", "epoch").agg(F.collect_list(F.struct("from", "n")).alias("spans"), F.sum("n").alias("n"),
                                                     F.first("size").alias("size"))
              .groupBy("key").agg(F.collect_list(F.struct("spans", "n", "size")).alias("_passes")))

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([cut_words(t, s) for t, s in zip(text, spans, strict=True)], dtype=object)

    names = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumn("_key", row_key(docs))
    # rows that are equal in all columns share a key: their passes come together, so one of them carries all
    rows = keyed.join(passes.withColumnRenamed("key", "_key"), "_key").dropDuplicates(["_key"])
    rows = rows.withColumn("_pass", F.explode("_passes"))
    whole, part = rows.where("_pass.n = _pass.size"), rows.where("_pass.n < _pass.size")
    part = part.withColumn("text", cut("text", "_pass.spans"))
    out = whole.select(*names).unionByName(part.select(*names))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
