"""Building, reading and changing graphs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph, canonical


def add_nodes(graph: Graph, new: DataFrame) -> Graph:
    """Upsert vertices by id: new data replaces old."""
    kept = graph.vertices.join(new, "id", "left_anti")
    return replace(graph, vertices=kept.unionByName(new, allowMissingColumns=True))


def remove_nodes(graph: Graph, ids: DataFrame) -> Graph:
    """Without these vertices and all their edges; ids: one column id."""
    gone = ids.select("id").distinct()
    src, dst = gone.withColumnRenamed("id", "src"), gone.withColumnRenamed("id", "dst")
    return replace(graph, vertices=graph.vertices.join(gone, "id", "left_anti"), edges=graph.edges.join(src, "src", "left_anti").join(dst, "dst", "left_anti").select("src", "dst", "weight"))


def unknown_ends(graph: Graph, new: DataFrame) -> DataFrame:
    """Edges of ``new`` with an end that is no vertex."""
    src, dst = graph.vertices.select(F.col("id").alias("src")), graph.vertices.select(F.col("id").alias("dst"))
    return new.join(src, "src", "left_anti").unionByName(new.join(dst, "dst", "left_anti")).distinct()


def add_edges(graph: Graph, new: DataFrame, combine: str | None = None, ensure: bool = False) -> Graph:
    """Add (src, dst, weight) edges: later rows win over the graph's, or ``combine`` (min, max, sum) joins old and new.

    Edges to unknown vertices raise ValueError; with ``ensure`` their ends are added.
    """
    new = new if graph.directed else canonical(new)
    if not ensure and not unknown_ends(graph, new).isEmpty():
        raise ValueError("an edge has an end that is not a vertex")
    if combine:
        edges = graph.edges.unionByName(new).groupBy("src", "dst").agg(getattr(F, combine)("weight").alias("weight"))
    else:
        new = new.groupBy("src", "dst").agg(F.max("weight").alias("weight"))
        edges = graph.edges.join(new, ["src", "dst"], "left_anti").unionByName(new)
    graph = graph.with_edges(edges)
    if ensure:
        ends = new.select(F.col("src").alias("id")).unionByName(new.select(F.col("dst").alias("id"))).distinct().join(graph.vertices, "id", "left_anti")
        graph = replace(graph, vertices=graph.vertices.unionByName(ends, allowMissingColumns=True))
    return graph


def remove_edges(graph: Graph, gone: DataFrame) -> Graph:
    gone = gone if graph.directed else canonical(gone.withColumn("weight", F.lit(None)))
    return graph.with_edges(graph.edges.join(gone.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", "weight"))


def order(graph: Graph) -> DataFrame:
    return graph.vertices.agg(F.count(F.lit(1)).alias("n_nodes"))


def size(graph: Graph) -> DataFrame:
    return graph.edges.agg(F.count(F.lit(1)).alias("n_edges"))


def successors(graph: Graph, ids: DataFrame) -> DataFrame:
    """(id, successor, weight) for each id asked."""
    return graph.arcs().join(ids.select(F.col("id").alias("src")).distinct(), "src", "left_semi").select(F.col("src").alias("id"), F.col("dst").alias("successor"), "weight")


def predecessors(graph: Graph, ids: DataFrame) -> DataFrame:
    return graph.arcs().join(ids.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").select(F.col("dst").alias("id"), F.col("src").alias("predecessor"), "weight")


def neighbors(graph: Graph, ids: DataFrame) -> DataFrame:
    return graph.both_ways().join(ids.select(F.col("id").alias("src")).distinct(), "src", "left_semi").select(F.col("src").alias("id"), F.col("dst").alias("neighbor"), "weight")


def degrees(graph: Graph) -> DataFrame:
    """(id, out_degree, in_degree, degree) of all vertices; an undirected loop adds two to degree, one to the others."""
    arcs = graph.arcs()
    out = arcs.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"), F.sum((F.col("src") == F.col("dst")).cast("long")).alias("loops"))
    into = arcs.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    all_ = graph.vertices.select("id").join(out, "id", "left").join(into, "id", "left").na.fill(0, ["out_degree", "in_degree", "loops"])
    degree = F.col("out_degree") + (F.col("in_degree") if graph.directed else F.col("loops"))
    return all_.select("id", "out_degree", "in_degree", degree.alias("degree"))


def strengths(graph: Graph) -> DataFrame:
    """(id, strength): sum of the weights of outgoing arcs."""
    out = graph.arcs().groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("strength"))
    return graph.vertices.select("id").join(out, "id", "left").na.fill(0, ["strength"])
