"""Connected components of an edge table, by hooking to the smallest neighbour and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, component): the smallest node that each node of ``edges(a, b)`` reaches.

    Every round maps each live node to the smallest of itself and its neighbours, follows that map once
    more, and contracts the edges to the images; a connected part loses at least half of its nodes a round,
    and a path three quarters. Groups are reduced by map-side minima, so a hub costs a row for each task.
    Null ends and loops are dropped. No edges give no rows.
    """
    live = scratch.keep(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), f"{name}-edges-0"
    )
    both = live.select(F.col("a").alias("node")).union(live.select(F.col("b").alias("node"))).distinct()
    labels = scratch.keep(both.select("node", F.col("node").alias("component")), f"{name}-0")
    turn = 0
    while not live.isEmpty():
        turn += 1
        ends = live.select("a", "b").union(live.select("b", "a"))
        hook = scratch.keep(ends.groupBy("a").agg(F.least("a", F.min("b")).alias("to")), f"{name}-hook-{turn}")
        ahead = hook.select(F.col("a").alias("to"), F.col("to").alias("next"))
        jump = scratch.keep(
            hook.join(ahead, "to", "left").select("a", F.coalesce("next", "to").alias("to")), f"{name}-jump-{turn}"
        )
        moved = jump.select(F.col("a").alias("component"), F.col("to").alias("new"))
        labels = scratch.keep(
            labels.join(moved, "component", "left").select("node", F.coalesce("new", "component").alias("component")), f"{name}-{turn}"
        )
        left = live.join(jump, "a").select(F.col("to").alias("x"), "b")
        both_moved = left.join(jump.withColumnRenamed("a", "b"), "b").select("x", F.col("to").alias("y")).where("x <> y")
        live = scratch.keep(
            both_moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{name}-edges-{turn}"
        )
        scratch.drop(f"{name}-{turn - 1}", f"{name}-edges-{turn - 1}", f"{name}-hook-{turn}", f"{name}-jump-{turn}")
    return labels
