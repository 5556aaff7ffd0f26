"""Flows, cuts and the matchings that follow from them, as phases over shortest layers.

A phase finds the arcs on shortest residual paths from source to sink, pushes
all that fits down the layers, level by level, and takes back up what got
stuck. Every vertex of these layers reaches the sink, so each phase adds to
the flow; with whole capacities the phases end. How a vertex spreads what it
has over its arcs comes from running totals across partitions, so a hub's arcs
need not fit into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators.paths import bfs
from graphloom.plans import drop_saved, running_total, save


def _part(have: str, before: str, most: str) -> Column:
    """What of ``have`` falls to an arc that can take ``most`` after others took ``before``."""
    return F.greatest(F.lit(0.0), F.least(F.col(most), F.col(have) - F.col(before)))


def _residual(graph: Graph) -> DataFrame:
    arcs = graph.arcs().where("src <> dst and weight > 0").select("src", "dst", F.col("weight").cast("double").alias("cap"))
    back = arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0.0).alias("cap"))
    return arcs.unionByName(back).groupBy("src", "dst").agg(F.sum("cap").alias("cap"))


def _layers(graph: Graph, residual: DataFrame, source: object, sink: object) -> tuple[DataFrame, int]:
    """(src, dst, cap, level) of the arcs on shortest residual paths, and their length; 0 if there is none."""
    open_ = residual.where("cap > 0")
    at = lambda i: graph.vertices.where(F.col("id") == i).select("id")
    down = bfs(Graph(graph.vertices, open_.select("src", "dst", F.lit(1).alias("weight")), True), at(source))
    reached = down.where(F.col("id") == sink).first()
    if reached is None:
        return open_, 0
    up = bfs(Graph(graph.vertices, open_.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("weight")), True), at(sink), max_depth=reached["depth"])
    d, u = down.select(F.col("id").alias("src"), F.col("depth").alias("level")), up.select(F.col("id").alias("dst"), F.col("depth").alias("left"))
    on = open_.join(d, "src").join(u, "dst").where(F.col("level") + 1 + F.col("left") == reached["depth"])
    return save(on.select("src", "dst", "cap", "level"), "layers"), reached["depth"]


def _pushed(arcs: DataFrame, length: int, source: object) -> DataFrame:
    """(src, dst, kept) of one phase."""
    arcs = save(running_total(arcs, ["src"], [F.col("dst")], F.col("cap"), "before"), "arcs")
    have, pushed = None, None
    for level in range(length):  # down: all that fits
        here = arcs.where(F.col("level") == level)
        if have is None:
            sent = here.select("src", "dst", "level", F.col("cap").alias("push"))
        else:
            sent = here.join(have, "src").select("src", "dst", "level", _part("have", "before", "cap").alias("push"))
        sent = save(sent.where("push > 0"), "sent")
        pushed = sent if pushed is None else pushed.unionByName(sent)
        have = sent.groupBy(F.col("dst").alias("src")).agg(F.sum("push").alias("have"))
    pushed = save(running_total(pushed, ["dst"], [F.col("src")], F.col("push"), "before"), "pushed")
    gone, kept = None, None
    for level in range(length - 1, -1, -1):  # up: a vertex keeps what it could pass on
        here = pushed.where(F.col("level") == level)
        if gone is None:
            stay = here.select("src", "dst", F.col("push").alias("kept"))
        else:
            stay = here.join(gone, "dst").select("src", "dst", _part("have", "before", "push").alias("kept"))
        stay = save(stay.where("kept > 0"), "stay")
        kept = stay if kept is None else kept.unionByName(stay)
        gone = stay.groupBy(F.col("src").alias("dst")).agg(F.sum("kept").alias("have"))
    return kept


def _saturated(graph: Graph, source: object, sink: object, max_phases: int) -> DataFrame:
    """The residual arcs (src, dst, cap) of a maximum flow."""
    residual = save(_residual(graph), "residual")
    if source == sink:
        return residual
    for _ in range(max_phases):
        arcs, length = _layers(graph, residual, source, sink)
        if not length:
            return residual
        kept = _pushed(arcs, length, source)
        moved = kept.select("src", "dst", (-F.col("kept")).alias("cap")).unionByName(kept.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("kept").alias("cap")))
        old, residual = residual, save(residual.unionByName(moved).groupBy("src", "dst").agg(F.sum("cap").alias("cap")), "residual")
        drop_saved(old, arcs)
    raise RuntimeError("the flow did not settle")


def max_flow(graph: Graph, source: object, sink: object, max_phases: int = 1000) -> DataFrame:
    """(src, dst, flow) of a maximum flow with weights as capacities; only arcs with a net flow.

    Undirected edges carry either way. Capacities should be whole numbers (or
    multiples of one): then every phase adds at least that. Weights of 0 and
    less carry nothing. A missing end or source = sink gives no rows.
    """
    caps = _residual(graph).withColumnRenamed("cap", "most")
    left = _saturated(graph, source, sink, max_phases)
    return caps.join(left, ["src", "dst"]).where("most > cap").select("src", "dst", (F.col("most") - F.col("cap")).alias("flow"))


def flow_value(flow: DataFrame, source: object) -> DataFrame:
    """One row: the net flow out of the source."""
    out = F.when(F.col("src") == source, F.col("flow")).when(F.col("dst") == source, -F.col("flow")).otherwise(0.0)
    return flow.agg(F.coalesce(F.sum(out), F.lit(0.0)).alias("value"))


def min_cut(graph: Graph, source: object, sink: object, max_phases: int = 1000) -> DataFrame:
    """(id, source_side): the vertices that residual arcs of a maximum flow still reach from the source."""
    left = _saturated(graph, source, sink, max_phases).where("cap > 0")
    near = bfs(Graph(graph.vertices, left.select("src", "dst", F.lit(1).alias("weight")), True), graph.vertices.where(F.col("id") == source).select("id"))
    return graph.vertices.select("id").join(near.select("id", F.lit(True).alias("source_side")), "id", "left").na.fill(False, ["source_side"])


def cut_edges(graph: Graph, sides: DataFrame) -> DataFrame:
    """(src, dst, weight) of the edges that lead from the source's side to the other."""
    a, b = sides.select(F.col("id").alias("src"), F.col("source_side").alias("a")), sides.select(F.col("id").alias("dst"), F.col("source_side").alias("b"))
    return graph.edges.join(a, "src").join(b, "dst").where("a and not b" if graph.directed else "a <> b").select("src", "dst", "weight")


def maximum_matching(graph: Graph, sides: DataFrame) -> DataFrame:
    """(left, right) of a matching with most edges in a bipartite graph of whole-number ids; sides: (id, side) with side 0 or 1.

    It is a flow of one unit an edge from a new vertex over side 0 and side 1
    to another new vertex, whose ids lie below all others.
    """
    ends = graph.vertices.agg(F.min("id").alias("m")).first()["m"]
    if ends is None:
        return graph.edges.select(F.col("src").alias("left"), F.col("dst").alias("right")).limit(0)
    source, sink = ends - 1, ends - 2
    a, b = sides.select(F.col("id").alias("src"), F.col("side").alias("a")), sides.select(F.col("id").alias("dst"), F.col("side").alias("b"))
    across = graph.both_ways().join(a, "src").join(b, "dst").where("a = 0 and b = 1").select("src", "dst")
    lit = lambda x: F.lit(x).cast(graph.vertices.schema["id"].dataType)
    out = sides.where("side = 0").select(lit(source).alias("src"), F.col("id").alias("dst"))
    into = sides.where("side = 1").select(F.col("id").alias("src"), lit(sink).alias("dst"))
    edges = across.unionByName(out).unionByName(into).distinct().withColumn("weight", F.lit(1))
    vertices = graph.vertices.select("id").unionByName(graph.spark.range(1).select(F.explode(F.array(lit(source), lit(sink))).alias("id")))
    flow = max_flow(Graph(vertices, edges, True), source, sink)
    return flow.where((F.col("src") != source) & (F.col("dst") != sink)).select(F.col("src").alias("left"), F.col("dst").alias("right"))
