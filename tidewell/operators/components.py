"""Connected components of an edge list, as a fixed number of joins a round.

Alternating large-star and small-star steps (Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014): in each step a node's neighbours are linked to the smallest
node around it, so the graph shrinks to stars in few rounds (proven: log squared of the nodes;
in practice about the logarithm of the diameter). Edges stay
distributed; the driver sees only a count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewell.session import cut, uncut


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of u to the smallest node of u's neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links u and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root): for each node of `edges` (a, b) the smallest node of its component.

    Nodes may be of any type with an order. Null ends and loops are left out; a node that
    has only those has no row. Repeated and reversed edges are harmless. Raises
    RuntimeError if `rounds` don't suffice; a wrong result is never returned, since the last round must change nothing.
    """
    now = cut(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct())
    before = None
    for _ in range(rounds):
        last, now = now, cut(_small_star(_large_star(now)))
        uncut(last)
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (state.n, state.h) == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = (state.n, state.h)
    raise RuntimeError(f"components aren't stable after {rounds} rounds")
