"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.col("b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Edges are undirected pairs of longs; self-loops, repeats and nulls are
    dropped.  Every round is written to the shared folder and the loop ends at
    the fixpoint (stars around the smallest nodes), in a number of rounds
    logarithmic in practice.  An empty edge table gives an empty result.
    """
    current = written(
        edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct(), "cc-start")
    seen = _fingerprint(current)
    while seen[0]:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # large star: every larger neighbour moves to the smallest of the neighbourhood
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: of the smaller neighbours (and itself), all move to the smallest
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        current = written(small, "cc-round")
        now = _fingerprint(current)
        if now == seen:
            break
        seen = now
    stars = current.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    roots = current.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return stars.unionByName(roots)
