"""Connected components of a graph given as an edge table, on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladelake.llm import shared


def representatives(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, leader) for every node of an edge; nodes of one component, and they only, share a leader.

    Each round a node joins the first of its neighbours and itself in an order
    drawn anew by hash, and the graph shrinks to the nodes that were joined;
    edges inside a merged node go. Every round at least one end of each edge
    goes, so the edge tables of all rounds come to little more than the first.
    Each is written to the shared folder, so a lost executor costs no more
    than its tasks. No node's edges are ever gathered: firsts are combined
    before they are shuffled.
    """
    left = shared.materialize(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b"), "edges")
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        turn = F.lit(len(rounds))
        both = left.select(F.col("a").alias("u"), F.col("b").alias("v")).union(left.select("b", "a"))
        first = both.groupBy("u").agg(F.min_by("v", F.xxhash64("v", turn)).alias("v"))
        joined = first.select("u", F.when(F.xxhash64("v", turn) < F.xxhash64("u", turn), F.col("v")).otherwise(F.col("u")).alias("to"))
        joined = shared.materialize(joined, "joined")
        rounds.append(joined)
        ends = left.join(joined.select(F.col("u").alias("a"), F.col("to").alias("to_a")), "a").join(joined.select(F.col("u").alias("b"), F.col("to").alias("to_b")), "b")
        left = shared.materialize(ends.where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("leader"))
    found = rounds.pop()
    while rounds:
        later = found.select(F.col("u").alias("to"), F.col("to").alias("last"))
        found = rounds.pop().join(later, "to", "left").select("u", F.coalesce("last", "to").alias("to"))
    return found.select(F.col("u").alias("node"), F.col("to").alias("leader"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge, root being its component's smallest node."""
    found = shared.materialize(representatives(edges, a, b), "leaders")
    return found.join(found.groupBy("leader").agg(F.min("node").alias("root")), "leader").select("node", "root")
