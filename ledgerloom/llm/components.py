"""Connected components by alternating large-star and small-star rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import durable


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Tie each node's neighbours (larger ones, or smaller ones and itself) to its least neighbour."""
    if both_ways:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = near.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = near.groupBy("u").agg(F.min("v").alias("m"))
        out = near.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(a, b) for each node a of the undirected ``edges`` (a, b): b is the least node of its component.

    Least nodes themselves have no row. Each round is a table in the shared folder.
    """
    edges = durable(edges.filter("a <> b").select("a", "b").distinct(), "component-edges")
    last = None
    for _ in range(rounds):
        edges = durable(_star(_star(edges, True), False), "component-edges")
        state = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.crc32(F.concat_ws(",", "a", "b").cast("binary")))).first())
        if state == last:
            return edges
        last = state
    raise RuntimeError(f"components didn't settle in {rounds} rounds")
