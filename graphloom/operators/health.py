"""Distances, efficiency and mixing of whole graphs."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators.community import triangles
from graphloom.operators.paths import all_pairs_hops, distance_counts


def eccentricities(graph: Graph, sources: DataFrame | None = None) -> DataFrame:
    """(id, eccentricity): the largest distance from a vertex; null where it does not reach all."""
    n = graph.vertices.count()
    dist = distance_counts(graph, graph.vertices if sources is None else sources)
    return dist.groupBy(F.col("source").alias("id")).agg(F.when(F.sum("n") == n, F.max("dist")).alias("eccentricity"))


def diameter_and_radius(graph: Graph) -> DataFrame:
    """One row (diameter, radius); null if some vertex does not reach all others or there is none."""
    e = eccentricities(graph)
    whole = F.count(F.lit(1)) == F.count("eccentricity")
    return e.agg(F.when(whole, F.max("eccentricity")).alias("diameter"), F.when(whole, F.min("eccentricity")).alias("radius"))


def average_path_length(graph: Graph) -> DataFrame:
    n = graph.vertices.count()
    dist = distance_counts(graph, graph.vertices)
    return dist.agg(F.when((F.sum("n") == n * n) & F.lit(n > 1), F.sum(F.col("n") * F.col("dist")) / (n * (n - 1))).alias("average_path_length"))


def global_efficiency(graph: Graph) -> DataFrame:
    n = graph.vertices.count()
    dist = distance_counts(graph, graph.vertices).where("dist > 0")
    return dist.agg((F.coalesce(F.sum(F.col("n") / F.col("dist")), F.lit(0.0)) / max(1, n * (n - 1))).alias("global_efficiency"))


def local_efficiency(graph: Graph) -> DataFrame:
    """(id, efficiency) of the graph that a vertex's neighbours induce, the vertex left out; unweighted hops.

    All neighbourhoods are searched at once, each as a graph of its own with
    ids (center, vertex). Its edges come from the triangles of the center, each
    made once, so no vertex pairs up its neighbours.
    """
    arcs = graph.both_ways().where("src <> dst").select("src", "dst").distinct()
    around = arcs.select(F.col("src").alias("c"), F.col("dst").alias("v"))
    corner = lambda c, v, w: F.struct(F.col(c).alias("c"), F.col(v).alias("v"), F.col(w).alias("w"))
    corners = [corner(*x) for x in itertools.permutations("abc")]
    inside = triangles(Graph(graph.vertices, arcs.where("src < dst").withColumn("weight", F.lit(1)), False)).select(F.explode(F.array(*corners)).alias("x")).select("x.*")
    pair = lambda x: F.struct("c", F.col(x).alias("v"))
    local = Graph(around.select(pair("v").alias("id")), inside.select(pair("v").alias("src"), pair("w").alias("dst"), F.lit(1).alias("weight")), True)
    hops = all_pairs_hops(local).where("hops > 0").groupBy(F.col("source.c").alias("id")).agg(F.sum(1 / F.col("hops")).alias("e"))
    k = around.groupBy(F.col("c").alias("id")).agg(F.count(F.lit(1)).alias("k"))
    return graph.vertices.select("id").join(k, "id", "left").join(hops, "id", "left").select("id", F.when(F.col("k") > 1, F.coalesce("e", F.lit(0.0)) / (F.col("k") * (F.col("k") - 1))).otherwise(0.0).alias("efficiency"))


def assortativity(graph: Graph) -> DataFrame:
    """One row: the correlation of the degrees at the two ends of the arcs; 0 where all degrees are equal."""
    arcs = graph.arcs()
    d = arcs.groupBy("src").agg(F.count(F.lit(1)).cast("double").alias("d"))
    both = arcs.join(d.select("src", F.col("d").alias("x")), "src").join(d.select(F.col("src").alias("dst"), F.col("d").alias("y")), "dst", "left").na.fill(0.0, ["y"])
    m = both.agg(*(F.avg(e).alias(a) for a, e in {"x": F.col("x"), "y": F.col("y"), "xy": F.col("x") * F.col("y"), "xx": F.col("x") ** 2, "yy": F.col("y") ** 2}.items()))
    below = F.sqrt((F.col("xx") - F.col("x") ** 2) * (F.col("yy") - F.col("y") ** 2))
    return m.select(F.when(below > 1e-12, (F.col("xy") - F.col("x") * F.col("y")) / below).otherwise(0.0).alias("assortativity"))


def sampled_diameter(graph: Graph, sweeps: int = 4, seed: int = 0) -> DataFrame:
    """One row: a lower bound of the diameter in hops; each sweep starts at the vertex farthest from the last start."""
    from graphloom.operators.paths import bfs

    start = graph.vertices.select("id").orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(1)
    most = 0
    for _ in range(sweeps):
        far = bfs(graph, start).orderBy(F.desc("depth"), "id").limit(1).first()
        if far is None:
            break
        most = max(most, far["depth"])
        start = graph.vertices.where(F.col("id") == far["id"]).select("id")
    return graph.spark.range(1).select(F.lit(most).cast("long").alias("diameter"))
