"""Connected components by repeated contraction of edges under random orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage


def connected(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over ``edges`` (a, b: long, no nulls).

    Nodes are those that occur in edges; an edge from a node to itself names the
    node alone.  ``edges`` should be staged.  Each round every node points to
    the least of itself and its neighbours under that round's random order,
    pointers are followed once more, and edges move to the nodes pointed to;
    edges inside a node go.  A constant share of the nodes goes each round,
    for long chains too.  All tables are staged, so no round depends on earlier
    ones if executors are lost; aggregates combine before the shuffle, so a
    node with very many edges is cheap.
    """

    def rank(node: str, turn: int) -> Column:
        return F.struct(F.xxhash64(node, F.lit(turn)).alias("h"), F.col(node).alias("n"))

    def both(e: DataFrame) -> DataFrame:
        return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    left = stage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("label"))
    turn = 0
    while not left.isEmpty():
        low = both(left).groupBy("a").agg(F.min(rank("b", turn)).alias("low"))
        nearest = stage(low.select(F.col("a").alias("x"), F.least("low", rank("a", turn))["n"].alias("p")), "nearest")
        again = nearest.select(F.col("x").alias("p"), F.col("p").alias("q"))
        parent = stage(nearest.join(again, "p", "left").select("x", F.coalesce("q", "p").alias("to")), "parent")
        moved = left
        for side in ("a", "b"):
            moved = moved.join(parent.withColumnsRenamed({"x": side, "to": f"{side}2"}), side)
        left = stage(moved.where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "edges")
        moved_labels = labels.join(parent.withColumnRenamed("x", "label"), "label", "left")
        labels = stage(moved_labels.select("node", F.coalesce("to", "label").alias("label")), "labels")
        turn += 1
    lows = labels.groupBy("label").agg(F.min("node").alias("low"))
    return labels.join(lows, "label").select("node", F.col("low").alias("label"))
