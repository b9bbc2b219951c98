"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellshift.llm.shared import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (columns a, b), root the smallest node.

    Large star: every node links its larger neighbours to its smallest one. Small star:
    it links its smaller neighbours and itself to the smallest. Both are a minimum per
    node, combined before the shuffle, and a join that Spark splits where a node is hot.
    The number of rounds grows with the logarithm of the longest path. Links are written
    after each round and never leave the cluster; the driver sees one checksum.

    Null ends and loops are dropped; without edges the result is empty.
    """
    links = materialise(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
        .distinct()
    )
    before = None
    while (now := _checksum(links)) != before and now[0]:
        moved, before = materialise(_small_star(_large_star(links))), now
        discard(links)
        links = moved
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
        links.select("lo", F.col("lo").alias("root")).distinct()
    )


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
        links.select("lo", "hi")
    )
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    return (
        both.join(least, "u")
        .where("v > u AND v <> m")
        .select(F.col("m").alias("lo"), F.col("v").alias("hi"))
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = (
        links.join(least, "hi")
        .where("lo <> m")
        .select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
    )
    return least.select(F.col("m").alias("lo"), "hi").union(moved).distinct()


def _checksum(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("lo", "hi"))).first())
