"""Immediate dominators as a fixpoint over a tree: every vertex moves below the meeting point of its predecessors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators.paths import bfs
from graphloom.plans import drop_saved, save


def _lifts(tree: DataFrame) -> list[DataFrame]:
    """Tables (id, up) of the ancestors 1, 2, 4, ... arcs above; the last one still has a row."""
    lifts = [save(tree.where("id <> parent").select("id", F.col("parent").alias("up")), "lift")]
    while True:
        last = lifts[-1]
        twice = save(last.join(last.select(F.col("id").alias("up"), F.col("up").alias("top")), "up").select("id", F.col("top").alias("up")), "lift")
        if twice.isEmpty():
            drop_saved(twice)
            return lifts
        lifts.append(twice)


def _depths(tree: DataFrame) -> DataFrame:
    """(id, depth) of a tree (id, parent) whose root is its own parent, by pointer doubling."""
    state = save(tree.select("id", F.col("parent").alias("top"), (F.col("id") != F.col("parent")).cast("int").alias("depth")), "depths")
    while True:
        above = state.select(F.col("id").alias("top"), F.col("top").alias("further"), F.col("depth").alias("more"))
        old, state = state, save(state.join(above, "top").select("id", F.col("further").alias("top"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("moved")), "depths")
        drop_saved(old)
        if state.where("moved").isEmpty():
            return state.select("id", "depth")


def _meetings(asked: DataFrame, tree: DataFrame) -> DataFrame:
    """(id, meet): for each id the deepest vertex of the tree above or at all its rows' ``at``.

    All rows climb to the least depth among them, then up by powers of two as
    long as they stay apart, and one more; all ids at once, an aggregate a power.
    """
    lifts = _lifts(tree)
    state = asked.join(_depths(tree).withColumnRenamed("id", "at"), "at")
    least = state.groupBy("id").agg(F.min("depth").alias("level"))
    state = save(state.join(least, "id").select("id", "at", (F.col("depth") - F.col("level")).alias("over")), "climb")
    for k in range(len(lifts) - 1, -1, -1):
        up = lifts[k].select(F.col("id").alias("at"), "up")
        lifted = state.join(up, "at", "left").withColumn("go", F.col("over") >= (1 << k))
        old, state = state, save(lifted.select("id", F.when(F.col("go"), F.col("up")).otherwise(F.col("at")).alias("at"), F.when(F.col("go"), F.col("over") - (1 << k)).otherwise(F.col("over")).alias("over")).distinct(), "climb")
        drop_saved(old)
    state = state.select("id", "at")
    apart = lambda df, c: df.groupBy("id").agg((F.min(c) != F.max(c)).alias("apart"))
    for k in range(len(lifts) - 1, -1, -1):
        lifted = state.join(lifts[k].select(F.col("id").alias("at"), "up"), "at", "left")
        # where not all have such an ancestor, all are at one depth and none has it
        go = apart(lifted.where("up is not null"), "up").where("apart").select("id", F.lit(True).alias("go"))
        state = save(lifted.join(go, "id", "left").select("id", F.when(F.col("go"), F.col("up")).otherwise(F.col("at")).alias("at")).distinct(), "climb")
    split = apart(state, "at")
    top = state.join(split, "id").join(lifts[0].select(F.col("id").alias("at"), "up"), "at", "left")
    out = save(top.groupBy("id").agg(F.min(F.when(F.col("apart"), F.col("up")).otherwise(F.col("at"))).alias("meet")), "meetings")
    drop_saved(*lifts)
    return out


def dominators(graph: Graph, start: object, max_rounds: int = 10_000) -> DataFrame:
    """(id, dominator) of all vertices reached from ``start``: the last vertex before it on every path from there; start's is itself.

    The first tree is that of a breadth-first search. In a round every vertex
    moves below the vertex where its predecessors meet in the tree; what is
    above a vertex always holds its dominators, and once nothing moves it is
    them. Ancestors are kept by powers of two, n log n rows, never as whole sets.
    An unknown start gives no rows; an undirected graph counts as arcs both ways.
    """
    found = save(bfs(graph, graph.vertices.where(F.col("id") == start).select("id")), "reached")
    tree = save(found.select("id", F.coalesce("parent", "id").alias("parent")), "tree")
    reached = tree.select(F.col("id").alias("src"))
    arcs = graph.arcs().where("src <> dst").join(reached, "src", "left_semi").where(F.col("dst") != start)
    arcs = save(arcs.select(F.col("dst").alias("id"), F.col("src").alias("at")).distinct(), "preds")
    if arcs.isEmpty():
        return tree.withColumnRenamed("parent", "dominator")
    for _ in range(max_rounds):
        new = _meetings(arcs, tree).withColumnRenamed("meet", "now")
        new = save(tree.join(new, "id", "left").select("id", F.coalesce("now", "parent").alias("parent"), (F.col("now") != F.col("parent")).alias("moved")), "tree")
        tree, still = new.select("id", "parent"), new.where("moved").isEmpty()
        if still:
            return tree.withColumnRenamed("parent", "dominator")
    raise RuntimeError(f"dominators still move after {max_rounds} rounds")
