"""Connected components of an edge list, by alternating large-star and small-star steps.

Every step is a pair of aggregations; nothing about nodes or edges reaches the
driver but one count per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node in ``edges`` (columns ``a``, ``b``, both bigint).

    Self-loops and repeated edges are allowed, null ends are dropped, an empty
    edge list gives an empty result. Returns ``node``, ``component``.
    """
    pairs = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    links = stored(pairs.distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        # Large-star: every larger neighbour of a node is hung on the smallest of its neighbourhood.
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        # Small-star: every smaller neighbour, and the node itself, on the smallest one.
        down = large.where("a <> b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("low"))
        small = (
            down.join(least, "a")
            .select(F.col("b").alias("a"), F.col("low").alias("b"))
            .where("a <> b")
            .union(least.select("a", F.col("low").alias("b")))
            .distinct()
        )
        links = stored(small, "edges")
        mark = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
