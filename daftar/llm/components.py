"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the least of the node and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and the node, move to the least of them. Edges run from larger a to smaller b."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """edges: a long, b long. Returns node long, root long (the component's least node), for every node of an edge.

    Each round is written to the shared folder, where it takes the place of the one before. Both star steps aggregate with partial minima before the shuffle, so a node
    with many neighbours costs one row per task. Ends when a round changes nothing; raises if that takes over max_rounds.
    """
    now = materialise(_small_star(edges.select("a", "b").where("a <> b")))
    state = None
    for _ in range(max_rounds):
        before, now = now, materialise(_small_star(_large_star(now)))
        discard(before)
        sums = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if state == sums:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        state = sums
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
