"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is two grouped minimums and joins; each round is written to the shared
folder.  The joins don't gather the links of one node in one task.  Links and labels never come to the driver, only their count and checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import FEW_ROWS, cut, free, join_one


def _join(edges: DataFrame, least: DataFrame, total: int, few: int) -> DataFrame:
    """edges (a, b) with least (a, m), which is taken from the ``total`` edges: at most two rows an edge."""
    return edges.join(F.broadcast(least), "a") if total <= few else join_one(edges, "a", least, total, few)


def _large(e: DataFrame, total: int, few: int) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _join(both.where("b > a"), least, total, few).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(e: DataFrame, total: int, few: int) -> DataFrame:
    down = e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = _join(down, least, total, few)
    return joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, rounds: int = 60, few: int = FEW_ROWS) -> DataFrame:
    """links (a long, b long) -> (node, component): the smallest node that each linked node reaches."""
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    for _ in range(rounds):
        mark = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        if mark[0] == 0 or mark == seen:
            break
        seen = mark
        large = cut(_large(edges, mark[0], few), "links-large", mark[0])
        before, edges = edges, cut(_small(large, mark[0], few), "links", mark[0])
        free(before, large)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
