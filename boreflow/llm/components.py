"""Connected components of an undirected edge table, by repeated contraction.

In each round every node points to the member of its neighbourhood (itself included) that a hash of the round ranks
first; edges are rewritten to those members, loops and repeats go, and the next round works on what is left.  A hash
that changes each round keeps chains and stars alike shrinking by a constant factor, so rounds are logarithmic in the
longest chain.  Everything is joins and grouped minima: a hub's edges are aggregated before the shuffle, and joins on a
hub are inner joins that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boreflow.llm.shared import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, src: str = "src", dst: str = "dst") -> DataFrame:
    """Rows (node, component) for each node of an edge; component is the smallest node reachable.

    Null ends are ignored; loops give a component of one node; an empty table gives an empty one.
    """
    name = f"cc-{id(edges):x}"
    ends = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    ends = ends.select(F.col(src).alias("a"), F.col(dst).alias("b"))
    nodes = ends.select(F.col("a").alias("node")).union(ends.select(F.col("b").alias("node"))).distinct()
    nodes = scratch.save(nodes, f"{name}-nodes")
    left = ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = scratch.save(left, f"{name}-0")
    hops, n = [], 0
    while not left.isEmpty():
        n += 1
        both = left.union(left.select("b", "a")).toDF("node", "other")
        rank = lambda c, n=n: F.struct(F.xxhash64(F.lit(n), c).alias("h"), F.col(c).alias("to"))
        hop = both.groupBy("node").agg(F.min(rank("other")).alias("best"))
        hop = hop.select("node", F.least("best", rank("node")).getField("to").alias("to"))
        hop = scratch.save(hop, f"{name}-hop{n}")
        hops.append(hop)
        a, b = hop.toDF("a", "x"), hop.toDF("b", "y")
        after = left.join(a, "a").join(b, "b").where("x <> y")
        after = after.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        left = scratch.save(after, f"{name}-{n}")
        scratch.drop(f"{name}-{n - 1}")
    at = nodes.withColumn("to", F.col("node"))
    for hop in hops:
        at = at.join(hop.toDF("to", "next"), "to", "left").select("node", F.coalesce("next", "to").alias("to"))
    at = scratch.save(at, f"{name}-at")
    least = at.groupBy("to").agg(F.min("node").alias("component"))
    return at.join(least, "to").select("node", "component")
