"""Fuzzy news-title dedup.

Greedy keep-first inside a day: rows are walked in (stock_id, date, id) order;
a kept row removes every later row of the same day whose normalised title has
an indel similarity >= threshold; a removed row removes nobody.  That is the
lexicographically first maximal independent set of the similarity graph.

Distributed form, exact at every step:

1. exact-equal normalised titles of a day collapse to their first row (equal
   strings have identical scores, so only the first can ever be kept);
2. the keys of a day, sorted by length, are cut into blocks of bounded size.
   similarity >= t needs min(l1, l2) >= t(l1+l2)/2, so a block meets only the
   blocks whose lengths are near its own; every such pair of blocks is a group of
   its own, so no task holds more than two blocks and a day of any size is
   compared by many tasks.  Only keys travel (a key goes to the blocks its block
   meets); candidate pairs are never written or shuffled;
3. inside a pair of blocks (``lcs.similar_keys``) pairs with enough characters in
   common, and enough in common order in each part of the alphabet, are verified
   with a bit-parallel LCS over many pairs at a time;
4. the greedy order is resolved in DataFrame rounds: a node with no undecided or
   kept predecessor is kept, an undecided node with a kept predecessor is
   removed; the first undecided node of every day is decided each round, and
   every round is checkpointed to the shared checkpoint folder.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from ..sources.files import scratch_path
from ._util import distributed_rank
from .lcs import similar_keys

THRESHOLD = 85
HOT_ROWS = 1000  # keys of a block: a group compares two blocks of a day
BLOCKS = 32  # a day of more blocks gets larger ones, of up to 20 * HOT_ROWS keys, so that a key is not copied to more and more


def normalize_title(c: Column) -> Column:
    """Cut from the first hyphen followed by a non-space to the end of the line,
    then delete every character that is not a letter, digit or underscore (Python's
    Unicode ``[\\s\\W]``).  Null -> ''."""
    t = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)\s*-\s*\S+.*$", "")
    return F.regexp_replace(t, r"[^\p{L}\p{N}_]", "")


def day_key(c: Column) -> Column:
    """D3: first 10 characters of the date text."""
    return F.substring(c.cast("string"), 1, 10)


def order_in_day(df: DataFrame, day: str = "_day", order=("stock_id", "date", "id"), tie: str | None = None) -> DataFrame:
    """Rank inside the day by (stock_id, date) with the id as tiebreak; a day of any size is ranked by many tasks."""
    return distributed_rank(df, [day], order, tie=tie)


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence (bit-parallel, Hyyrö 2004)."""
    if not a or not b:
        return 0
    if len(a) < len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for i, ch in enumerate(b):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(b)) - 1
    v = full
    for ch in a:
        u = v & masks.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(b) - bin(v).count("1")


def _ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def indel_ratio_py(a: str, b: str) -> float:
    """Normalised indel similarity 0-100 = 200 * LCS / (len(a) + len(b)); 100 for two empty strings."""
    n = len(a) + len(b)
    if n == 0:
        return 100.0
    return 200.0 * lcs_length(a, b) / n


def similar_py(a: str, b: str, threshold: int = THRESHOLD) -> bool:
    """Exact integer form of ratio >= threshold."""
    n = len(a) + len(b)
    if n == 0:
        return True
    return 200 * lcs_length(a, b) >= threshold * n


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """D4 as a vectorised UDF (applied to candidate pairs only)."""
    return pd.Series([indel_ratio_py(x or "", y or "") for x, y in zip(a, b)], dtype="float64")


def block_pairs(nodes: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(_day, _i, _j, _right, _node, _len, _norm): the keys of every two blocks that can hold a similar pair.

    ``nodes``: (_day, _node, _norm, _len); _node is the rank of the node in its day.
    A day's keys are ranked by length and cut into blocks of ``HOT_ROWS``; a day that
    would have over ``BLOCKS`` of them gets larger ones, of 20 * ``HOT_ROWS`` at most:
    the copies of a key are bounded up to 640,000 keys a day, a group's rows always.
    A pair of blocks _i <= _j holds the keys of _i and, if that is another one, of _j (``_right``).
    Empty keys are similar to no other key.
    """
    keys = nodes.filter("_day IS NOT NULL AND _len > 0").select(
        "_day", F.col("_node").cast("long").alias("_node"), F.col("_len").cast("int").alias("_len"), "_norm")
    keys = _written(keys, "title-keys")
    size = F.least(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCKS), F.lit(HOT_ROWS)), F.lit(20 * HOT_ROWS))
    ranked = distributed_rank(keys, ["_day"], ["_len", "_node"]).join(keys.groupBy("_day").agg(size.alias("_size")), "_day")
    ranked = ranked.withColumn("_block", F.floor((F.col("_rn") - 1) / F.col("_size")).cast("int")).drop("_rn", "_size")
    ranked = _written(ranked, "title-blocks")
    blocks = ranked.groupBy("_day", "_block").agg(F.min("_len").alias("_min"), F.max("_len").alias("_max"))
    later = blocks.select("_day", F.col("_block").alias("_j"), F.col("_min").alias("_later"))
    # length bound in integers: 200 * min(l1, l2) >= threshold * (l1 + l2)
    meet = blocks.withColumnRenamed("_block", "_i").join(later, "_day").filter(
        (F.col("_i") == F.col("_j")) | ((F.col("_i") < F.col("_j"))
                                        & (F.lit(200 - threshold) * F.col("_max") >= F.lit(threshold) * F.col("_later"))))
    meet = meet.select("_day", "_i", "_j")
    left = ranked.withColumnRenamed("_block", "_i").join(meet, ["_day", "_i"]).withColumn("_right", F.lit(False))
    right = ranked.withColumnRenamed("_block", "_j").join(meet.filter("_i < _j"), ["_day", "_j"]).withColumn("_right", F.lit(True))
    return left.unionByName(right)


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def similar_pairs(nodes: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Verified pairs (day, lo, hi, ratio) with ratio >= threshold.

    Two empty keys count as equal (ratio 100); they never meet here because
    equal keys are collapsed before pairing.
    """
    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_right", "_len"], kind="stable")
        split = int((~group["_right"]).sum())
        text, node, size = group["_norm"].tolist(), group["_node"].to_numpy(), group["_len"].to_numpy()
        a, b, lcs = similar_keys(text[:split], text[split:] or None, threshold)
        b = b + (split if split < len(text) else 0)
        return pd.DataFrame({"_day": group["_day"].iloc[0], "lo": node[[a, b]].min(axis=0), "hi": node[[a, b]].max(axis=0),
                             "ratio": 200.0 * lcs / (size[a] + size[b])})

    # the comparison is CPU-bound: as many tasks as the session sets for a shuffle, not as few as the keys' bytes fill
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = block_pairs(nodes, threshold).repartition(parts, "_day", "_i", "_j")
    return held.groupBy("_day", "_i", "_j").applyInPandas(compare, "_day string, lo long, hi long, ratio double")


def _greedy(edges: DataFrame, spark) -> DataFrame:
    """Resolve keep-first on the edge set; returns (_day, _node, kept) for nodes with edges."""
    ensure_checkpoint_dir(spark)
    e = edges.select("_day", "lo", "hi").checkpoint()   # materialise the verified edges once
    nodes = e.select("_day", F.col("lo").alias("_node")).union(e.select("_day", F.col("hi").alias("_node"))) \
        .distinct().withColumn("_s", F.lit("U"))
    nodes = nodes.checkpoint()
    # ends: the first undecided node of every day is decided in each round
    while not nodes.filter(F.col("_s") == "U").isEmpty():
        pred = e.join(nodes.select("_day", F.col("_node").alias("lo"), F.col("_s").alias("_ps")), ["_day", "lo"])
        agg = pred.groupBy("_day", F.col("hi").alias("_node")).agg(
            F.max(F.when(F.col("_ps").isin("U", "K"), 1).otherwise(0)).alias("_blocked"),
            F.max(F.when(F.col("_ps") == "K", 1).otherwise(0)).alias("_hit"))
        nxt = nodes.join(agg, ["_day", "_node"], "left").withColumn(
            "_s",
            F.when(F.col("_s") != "U", F.col("_s"))
            .when(F.coalesce(F.col("_blocked"), F.lit(0)) == 0, F.lit("K"))
            .when(F.col("_hit") == 1, F.lit("R"))
            .otherwise(F.lit("U"))).select("_day", "_node", "_s")
        nodes = nxt.checkpoint()
    return nodes.select("_day", "_node", (F.col("_s") == "K").alias("kept"))


def fuzzy_dedup(df: DataFrame, threshold: int = THRESHOLD, title: str = "title", date: str = "date",
                order=("stock_id", "date", "id"), with_flag: bool = False) -> DataFrame:
    """Keep-first fuzzy dedup of titles inside each day (across stock ids).

    Returns the kept rows (or all rows with a ``kept`` flag when ``with_flag``).
    """
    spark = df.sparkSession
    base = df.withColumn("_day", F.coalesce(day_key(F.col(date)), F.lit(""))).withColumn("_norm", normalize_title(F.col(title)))
    base = order_in_day(base, "_day", order)
    # 1. equal keys: first row per (day, key) is the node; the node rank keeps the day order
    first = base.groupBy("_day", "_norm").agg(F.min("_rn").alias("_rep"))
    nodes = first.withColumn("_node", F.col("_rep")).withColumn("_len", F.length("_norm"))
    # 2-3. verified similarity edges between distinct keys
    edges = similar_pairs(nodes.select("_day", "_node", "_norm", "_len"), threshold)
    # 4. greedy resolution on the nodes that have edges
    decided = _greedy(edges, spark)
    node_state = nodes.join(decided, ["_day", "_node"], "left").select(
        "_day", "_norm", "_rep", F.coalesce(F.col("kept"), F.lit(True)).alias("_node_kept"))
    out = base.join(node_state, ["_day", "_norm"]).withColumn(
        "kept", (F.col("_rn") == F.col("_rep")) & F.col("_node_kept"))
    out = out.drop("_norm", "_rep", "_node_kept", "_rn", "_day")
    return out if with_flag else out.filter(F.col("kept")).drop("kept")


def dedup_stats(flagged: DataFrame, date: str = "date") -> DataFrame:
    """Original, kept and removed rows per day, with a grand total (day NULL)."""
    d = flagged.withColumn("_day", day_key(F.col(date)))
    return d.rollup("_day").agg(
        F.count(F.lit(1)).alias("original"),
        F.count_if(F.col("kept")).alias("kept"),
        F.count_if(~F.col("kept")).alias("removed"),
    ).withColumnRenamed("_day", "day")
