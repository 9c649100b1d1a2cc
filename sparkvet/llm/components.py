"""Connected components by alternating large and small stars; no part of the graph is gathered in one task or the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

HUB_SHARE = 256


def _hubs(edges: DataFrame, node: str, total: int) -> list[int]:
    """Nodes at that end of over 1/HUB_SHARE of all edges, so fewer than HUB_SHARE."""
    counts = edges.groupBy(node).agg(F.count("*").alias("n"))
    return [r[0] for r in counts.where(F.col("n") * HUB_SHARE > total).select(node).collect()]


def _least_of(near: DataFrame) -> DataFrame:
    """u, m: the least of u and its neighbours. near: u, v."""
    return near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Links the larger neighbours of each node to the least node around it. Edges: a > b."""
    least = _least_of(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))))
    larger = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    joined = common.salted_join(larger, least, "u", F.col("v"), _hubs(edges, "b", total), how="inner")
    return joined.select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Links each node and its smaller neighbours to the least of them."""
    smaller = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    joined = common.salted_join(smaller, _least_of(smaller), "u", F.col("v"), _hubs(edges, "a", total), how="inner")
    return joined.select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def checksum(*columns: str) -> tuple[Column, Column]:
    """Number of rows and the exclusive or of their hashes, which no number of rows can overflow."""
    return F.count("*"), F.coalesce(F.bit_xor(F.xxhash64(*columns)), F.lit(0))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a long, b long); root is the least node that can be reached.

    Edges may repeat, point either way or be loops; a node with loops alone is left out, as is any null. The edges of a hub (a node with a
    large share of all edges) are dealt over salted parts.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct()
    edges = common.materialize(edges, "edges")
    total, before = edges.count(), None
    for _ in range(most_rounds):
        edges = common.materialize(_large_star(edges, total), "edges")
        total = edges.count()
        edges = common.materialize(_small_star(edges, total), "edges")
        now = tuple(edges.agg(*checksum("a", "b")).first())
        if not now[0] or now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
        total, before = now[0], now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
