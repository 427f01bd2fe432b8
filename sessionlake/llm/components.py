"""Connected components of an edge table, with joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.scratch import written


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `edges` (a, b), component = least node reachable.

    Alternates "large star" (every larger neighbour moves to the least
    neighbour) and "small star" (every smaller neighbour does), which ends
    after a number of rounds logarithmic in the size of a component. Each round
    is two aggregates with partial sums and two equi-joins, so a node with very
    many neighbours is split by the skew join; nothing goes to the driver but
    two numbers. Self-loops and repeated edges are harmless; null ends are
    ignored; an empty table gives an empty result.
    """
    a, b = F.col("a"), F.col("b")
    pairs = edges.where(a.isNotNull() & b.isNotNull())
    pairs = pairs.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    now, seen = written(pairs), None
    for _ in range(rounds):
        both = now.unionByName(now.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), a).alias("m"))
        large = both.where(b > a).join(least, "a").select(b.alias("a"), F.col("m").alias("b"))
        # a node that is its own least neighbour keeps its edge through the other end
        large = large.where(a != b).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(b.alias("a"), F.col("m").alias("b")).where(a != b)
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        now = written(small)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    tops = now.select(b.alias("node")).distinct().select("node", F.col("node").alias("component"))
    loops = edges.where(F.col("a") == F.col("b")).select(a.alias("node"), a.alias("component"))
    members = now.select(a.alias("node"), b.alias("component"))
    return members.unionByName(tops).unionByName(loops).groupBy("node").agg(F.min("component").alias("component"))
