"""Connected components of links, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b), a > b. Every node's neighbours are linked to the least of them (large: those above it; else it and those below it)."""
    near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        near = near.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    # Kept, so that both sides of the join are plain shuffles and one with a node of many links can be split
    least = X.kept(near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
    joined = near.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        out = out.union(edges.where("false"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a > b").distinct()


def components(links: DataFrame, rounds: int = 200) -> DataFrame:
    """links (a, b): each linked node with the least node of its component, as (node, component).

    Alternating large and small stars: every round shortens paths by half or more, aggregates are combined
    before they are shuffled, and a node of many links is split by skewed joins. Lineage is cut each round.
    Links to oneself count for nothing; nulls are dropped; empty links give no rows. rounds: after as many without an end,
    which would take paths of more than 2 ** rounds links, it raises RuntimeError.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = X.kept(edges)
    sign = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = sign(edges)
    for _ in range(rounds if before[0] else 0):
        edges = X.kept(_stars(_stars(edges, True), False))
        now = sign(edges)
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError(f"links haven't settled after {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
