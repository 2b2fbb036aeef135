"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm._shared import durable, release


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(node, root)``; root is the smallest node reachable.

    Only nodes with an edge to another node appear.  Self-loops, repeats and nulls are ignored.
    Neighbour minima are partial aggregates, so a node with very many neighbours is
    never gathered in one task.  Each round is written to the shared folder.
    """
    pairs = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).distinct()
    state = durable(pairs, "edges")
    seen = _signature(state)
    while seen[0]:
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # a join with a written aggregate has plain shuffles on both sides, so a frequent node can be split
        low = durable(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star-lows")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = durable(large, "large-star")
        least = durable(large.groupBy("u").agg(F.min("v").alias("m")), "star-lows")
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, state = state, durable(moved.union(least).distinct(), "small-star")
        release(old, low, large, least)
        now = _signature(state)
        if now == seen:
            break
        seen = now
    return state.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _signature(pairs: DataFrame) -> tuple:
    mixed = F.xxhash64("u", "v")
    row = pairs.agg(
        F.count("*"), F.sum(mixed.bitwiseAND(0xFFFFFFFF)), F.sum(F.shiftrightunsigned(mixed, 32))
    ).first()
    return tuple(row)
