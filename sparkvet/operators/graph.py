"""Reachability over call edges as bounded loops of joins; every round is written out, so lineage stays short."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder; without one set, a folder of the warehouse serves."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints-{uuid.uuid4().hex[:8]}")
    return df.checkpoint(eager=True)


def walk(roots: DataFrame, edges: DataFrame, depth: int = 5) -> DataFrame:
    """Breadth first from roots (root, node): (root, node, depth, chain, ord) of every node, by its first shortest chain.

    edges: caller, callee, at (place of the call). A node is visited once a root; of several callers of one round the one that was queued
    first and its earliest call count, as in a queue. A root has depth 0, and chains stop at `depth`.
    """
    calls = edges.groupBy("caller", "callee").agg(F.min("at").alias("at"))
    start = roots.select("root", "node").distinct()
    frontier = start.select("root", "node", F.lit(0).alias("depth"), F.array("node").alias("chain"), F.row_number().over(Window.partitionBy("root").orderBy("node")).cast("long").alias("ord"))
    frontier = cut(frontier)
    seen = frontier
    for d in range(1, depth + 1):
        queued = frontier.select(F.col("root").alias("root_"), F.col("node").alias("node_"), F.col("ord").alias("po"), F.col("chain").alias("pc"))
        met = queued.join(calls, F.col("node_") == F.col("caller")).select(F.col("root_").alias("root"), F.col("callee").alias("node"), "po", "at", "pc")
        known = seen.select(F.col("root").alias("r"), F.col("node").alias("n"))
        fresh = met.join(known, (F.col("root") == F.col("r")) & (F.col("node") == F.col("n")), "left_anti")
        first = fresh.groupBy("root", "node").agg(F.min(F.struct("po", "at", "pc")).alias("x"))
        queue = Window.partitionBy("root").orderBy("x.po", "x.at", "node")
        frontier = cut(first.select("root", "node", F.lit(d).alias("depth"), F.concat("x.pc", F.array("node")).alias("chain"), F.row_number().over(queue).cast("long").alias("ord")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)  # each round stands in a checkpoint of its own
    return seen


def cut_off(reached: DataFrame, edges: DataFrame, depth: int = 5) -> DataFrame:
    """(root, node, at): nodes at the greatest depth that call something unvisited, with the first such call."""
    last = reached.where(F.col("depth") == depth).select("root", "node")
    calls = last.join(edges.withColumnRenamed("caller", "node"), "node")
    missed = calls.join(reached.select("root", F.col("node").alias("callee")), ["root", "callee"], "left_anti")
    return missed.groupBy("root", "node").agg(F.min("at").alias("at"))


def closure(start: DataFrame, edges: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """All (node) reachable from start (node) over edges (caller, callee), start included; rounds stop when nothing is new."""
    seen = cut(start.select("node").distinct())
    frontier = seen
    for i in range(1, most_rounds):
        met = frontier.join(edges, F.col("node") == F.col("caller")).select(F.col("callee").alias("node")).distinct()
        known = seen.select(F.col("node").alias("n"))
        frontier = cut(met.join(known, F.col("node") == F.col("n"), "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = seen.union(frontier)
        if i % 16 == 0:
            seen = cut(seen)  # keeps the plan small
    raise RuntimeError("closure did not settle")
