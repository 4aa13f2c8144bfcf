"""Connected components of a link table, by star contraction in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v, least): each edge of u with the smallest of u and its neighbours."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))
    return edges.join(least, "u")


def large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node are tied to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    met = _with_least(down)
    return met.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(met.select("u", F.col("least").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links (u, v) but the roots, which are the smallest of their components.

    Each round is written to the shared folder, and the one before it deleted. It ends when a round changes nothing:
    then the edges are stars. Every round that changes an edge ties it to a smaller node, so there is such a round.
    """
    edges = stored(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    sign = None
    while True:
        before, edges = edges, stored(small_star(large_star(edges)), "stars")
        discard(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == sign:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        sign = now
