"""Estimates and bounds whose work does not follow the exact answer's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators import structure, transforms
from graphloom.operators.paths import distance_counts
from graphloom.plans import running_total, save


def vertex_cover(graph: Graph) -> DataFrame:
    """(id): both ends of a maximal matching and all vertices with loops; at most twice the smallest cover (loops aside)."""
    pairs = structure.maximal_matching(graph)
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.unionByName(graph.edges.where("src = dst").select(F.col("src").alias("id"))).distinct()


def transitivity(graph: Graph, samples: int = 10_000, seed: int = 0) -> DataFrame:
    """One row (transitivity): the share of closed wedges among about ``samples`` drawn ones; 0 where there is no wedge.

    A vertex draws its share of the wedges, rounded at random, so a hub's work
    is bounded by the sample. The same draws on any cluster.
    """
    arcs = save(graph.both_ways().where("src <> dst").select("src", "dst").distinct(), "arcs")
    degrees = save(arcs.groupBy("src").agg(F.count(F.lit(1)).alias("d")).where("d > 1"), "degrees")
    total = degrees.agg(F.sum(F.col("d") * (F.col("d") - 1) / 2)).first()[0]
    if not total:
        return graph.spark.range(1).select(F.lit(0.0).alias("transitivity"))
    h = lambda *of: F.xxhash64(F.lit(seed), "src", *of)
    share = F.col("d") * (F.col("d") - 1) / 2 * samples / total
    n = F.floor(share + F.pmod(h(), F.lit(1 << 53)) / float(1 << 53)).cast("int")
    draws = degrees.withColumn("n", n).where("n > 0").select("src", "d", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("t"))
    i, j = F.pmod(h("t", F.lit(1)), F.col("d")), F.pmod(h("t", F.lit(2)), F.col("d") - 1)
    draws = draws.select("src", i.alias("i"), (j + (j >= i).cast("long")).alias("j"))
    ranked = save(running_total(arcs, ["src"], [F.col("dst")], F.lit(1).cast("long"), "k"), "ranked")
    at = lambda k, name: ranked.select("src", F.col("k").alias(k), F.col("dst").alias(name))
    wedges = draws.join(at("i", "a"), ["src", "i"]).join(at("j", "b"), ["src", "j"])
    closed = arcs.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1.0).alias("closed"))
    return wedges.join(closed, ["a", "b"], "left").agg(F.coalesce(F.avg(F.coalesce("closed", F.lit(0.0))), F.lit(0.0)).alias("transitivity"))


def _pivot_distances(graph: Graph, pivots: int | None, seed: int) -> tuple[DataFrame, DataFrame, int, int]:
    """All ids, (id, dist, n) of the drawn pivots that a vertex reaches at a distance, n to be summed, the number of vertices and of pivots."""
    ids = save(graph.vertices.select("id").distinct(), "ids")
    n = ids.count()
    k = min(n, max(1, int(n**0.5)) if pivots is None else pivots)
    drawn = save(ids.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(k), "pivots")
    return ids, distance_counts(transforms.transpose(graph) if graph.directed else graph, drawn, "id"), n, k


def closeness(graph: Graph, pivots: int | None = None, seed: int = 0) -> DataFrame:
    """(id, score): closeness from the distances to ``pivots`` drawn vertices (the root of their number by default); with all as pivots it is exact.

    A vertex that does not reach every pivot scores 0.
    """
    ids, dist, n, k = _pivot_distances(graph, pivots, seed)
    by = dist.groupBy("id").agg(F.sum("n").alias("r"), F.sum(F.col("n") * F.col("dist")).alias("total"))
    score = F.when((F.col("r") == k) & (F.col("total") > 0), k * (n - 1) / (n * F.col("total")))
    return ids.join(by, "id", "left").select("id", F.coalesce(score, F.lit(0.0)).alias("score"))


def harmonic(graph: Graph, pivots: int | None = None, seed: int = 0) -> DataFrame:
    """(id, score): harmonic centrality from the distances to drawn pivots, scaled to all vertices; exact with all as pivots."""
    ids, dist, n, k = _pivot_distances(graph, pivots, seed)
    by = dist.where("dist > 0").groupBy("id").agg(F.sum(F.col("n") / F.col("dist")).alias("total"))
    return ids.join(by, "id", "left").select("id", (F.coalesce("total", F.lit(0.0)) * n / (max(1, k) * max(1, n - 1))).alias("score"))
