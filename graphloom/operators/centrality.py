"""Centrality measures: fixed point iterations and multi-source searches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators.paths import distance_counts, sssp
from graphloom.operators.searches import search
from graphloom.plans import save
from graphloom.plans.fixpoint import fixpoint, rounds


def _n(graph: Graph) -> int:
    return graph.vertices.count()


def degree(graph: Graph, mode: str = "total") -> DataFrame:
    """(id, score): neighbours by ``mode`` (in, out, total) over n - 1; an undirected loop counts once."""
    arcs = graph.arcs()
    ends = {"out": ["src"], "in": ["dst"], "total": ["src", "dst"] if graph.directed else ["src"]}[mode]
    found = None
    for c in ends:
        one = arcs.select(F.col(c).alias("id"))
        found = one if found is None else found.unionByName(one)
    counts = found.groupBy("id").agg(F.count(F.lit(1)).alias("c"))
    return graph.vertices.select("id").join(counts, "id", "left").select("id", (F.coalesce("c", F.lit(0)) / max(1, _n(graph) - 1)).alias("score"))


def closeness(graph: Graph, sources: DataFrame | None = None, improved: bool = False) -> DataFrame:
    """(id, score): (n - 1) / sum of outgoing distances, 0 where not all can be reached; ``improved`` scales by the part reached."""
    n = _n(graph)
    dist = distance_counts(graph, graph.vertices if sources is None else sources)
    by = dist.groupBy(F.col("source").alias("id")).agg(F.sum("n").alias("r"), F.sum(F.col("n") * F.col("dist")).alias("total"))
    reached = F.col("r") - 1
    score = reached / F.col("total") * reached / (n - 1) if improved else F.when(F.col("r") == n, (n - 1) / F.col("total"))
    return by.select("id", F.when((F.col("total") > 0), F.coalesce(score, F.lit(0.0))).otherwise(0.0).alias("score"))


def harmonic(graph: Graph, sources: DataFrame | None = None) -> DataFrame:
    """(id, score): sum of 1 / distance to all others over n - 1."""
    n = _n(graph)
    dist = distance_counts(graph, graph.vertices if sources is None else sources)
    return dist.groupBy(F.col("source").alias("id")).agg((F.coalesce(F.sum(F.when(F.col("dist") > 0, F.col("n") / F.col("dist"))), F.lit(0.0)) / max(1, n - 1)).alias("score"))


def shortest_path_dag(graph: Graph, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source, id, sigma), and the arcs (source, src, dst) that lie on shortest paths; weights must be positive."""
    arcs = graph.arcs().where("src <> dst").select("src", "dst", F.col("weight").cast("double").alias("weight"))
    dist = save(sssp(graph, sources), "dist")
    d0, d1 = dist.select("source", F.col("id").alias("src"), F.col("dist").alias("d0")), dist.select("source", F.col("id").alias("dst"), F.col("dist").alias("d1"))
    tight = save(d0.join(arcs, "src").join(d1, ["source", "dst"]).where(F.abs(F.col("d0") + F.col("weight") - F.col("d1")) <= 1e-9 * F.greatest(F.lit(1.0), F.abs("d1"))).select("source", "src", "dst"), "tight")
    start = dist.where("source = id").select("source", "id", F.lit(1.0).alias("x"), F.lit(0).alias("hop"))

    def step(state: DataFrame, hop: int) -> DataFrame:
        return state.join(tight, (state["source"] == tight["source"]) & (state["id"] == tight["src"])).groupBy(tight["source"], F.col("dst").alias("id")).agg(F.sum("x").alias("x"), F.lit(hop).alias("hop"))

    return _summed(start, step, ["source", "id"]).withColumnRenamed("total", "sigma"), tight


def _summed(front: DataFrame, step, keys: list[str], max_rounds: int = 100_000) -> DataFrame:
    """Sum of x over all rounds of a linear step on an acyclic structure: (keys, total)."""
    front = save(front, "front")
    parts = [front]
    for hop in range(1, max_rounds):
        front = save(step(front, hop), "front")
        if front.isEmpty():
            break
        if hop == max_rounds - 1:
            raise RuntimeError(f"sums still grow after {max_rounds} rounds")
        parts.append(front)
        if len(parts) == 16:  # keep the union of rounds short
            merged = parts[0]
            for p in parts[1:]:
                merged = merged.unionByName(p)
            parts = [save(merged.groupBy(*keys).agg(F.sum("x").alias("x"), F.max("hop").alias("hop")), "sums")]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    return merged.groupBy(*keys).agg(F.sum("x").alias("total"))


def _dependencies(graph: Graph, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source, id, total): 1 and the dependency of each source on the vertex; and (source, src, dst, share) of the arcs of shortest paths."""
    sigma, tight = shortest_path_dag(graph, sources)
    sigma = save(sigma, "sigma")
    a, b = sigma.select("source", F.col("id").alias("src"), F.col("sigma").alias("s0")), sigma.select("source", F.col("id").alias("dst"), F.col("sigma").alias("s1"))
    share = save(tight.join(a, ["source", "src"]).join(b, ["source", "dst"]).select("source", "src", "dst", (F.col("s0") / F.col("s1")).alias("share")), "share")
    start = sigma.select("source", "id", F.lit(1.0).alias("x"), F.lit(0).alias("hop"))

    def step(state: DataFrame, hop: int) -> DataFrame:
        return state.join(share, (state["source"] == share["source"]) & (state["id"] == share["dst"])).groupBy(share["source"], F.col("src").alias("id")).agg(F.sum(F.col("share") * F.col("x")).alias("x"), F.lit(hop).alias("hop"))

    return _summed(start, step, ["source", "id"]), share


def _sources(graph: Graph, sources: DataFrame | None) -> DataFrame:
    return graph.vertices if sources is None else sources.select("id").join(graph.vertices, "id", "left_semi")


def _arc_scores(graph: Graph, sources: DataFrame) -> DataFrame:
    total, share = _dependencies(graph, sources)
    head = total.select("source", F.col("id").alias("dst"), "total")
    return share.join(head, ["source", "dst"]).groupBy("src", "dst").agg(F.sum(F.col("share") * F.col("total")).alias("score"))


def _vertex_scores(graph: Graph, sources: DataFrame) -> DataFrame:
    total, _ = _dependencies(graph, sources)
    return total.where("source <> id").groupBy("id").agg(F.sum(F.col("total") - 1).alias("score"))


def edge_betweenness(graph: Graph, sources: DataFrame | None = None, scale: float = 1.0) -> DataFrame:
    """(src, dst, score) of every edge: shortest paths along it, not normalised, halved if undirected; loops have 0.

    An arc's part in a source's paths is its share of the paths to its head
    times 1 and the source's dependency on the head. ``sources`` and ``scale``
    as in ``betweenness``.
    """
    arcs = search(graph, graph.arcs(), _sources(graph, sources), "arc_scores", _arc_scores).withColumnRenamed("score", "x")
    if not graph.directed:
        arcs = arcs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), (F.col("x") / 2).alias("x"))
    score = arcs.groupBy("src", "dst").agg((F.sum("x") * scale).alias("score"))
    return graph.edges.select("src", "dst").join(score, ["src", "dst"], "left").na.fill(0.0, ["score"])


def betweenness(graph: Graph, sources: DataFrame | None = None, scale: float = 1.0) -> DataFrame:
    """(id, score): shortest paths through a vertex, ends excluded, not normalised, halved if undirected.

    The sources of a block run at once: path counts spread forward along the
    arcs of shortest paths, dependencies backward, a hop a round. With a sample
    of sources and ``scale`` = n / sample this estimates the measure.
    """
    delta = search(graph, graph.arcs(), _sources(graph, sources), "vertex_scores", _vertex_scores).groupBy("id").agg(F.sum("score").alias("score"))
    factor = scale * (1.0 if graph.directed else 0.5)
    return graph.vertices.select("id").join(delta, "id", "left").select("id", (F.coalesce("score", F.lit(0.0)) * factor).alias("score"))


def pagerank(graph: Graph, damping: float = 0.85, max_iter: int = 1000, tolerance: float = 1e-4) -> DataFrame:
    """(id, score) that sum to 1; unweighted; vertices without successors share their rank with all."""
    n = _n(graph)
    if n == 0:
        return graph.vertices.select("id", F.lit(0.0).alias("score"))
    arcs = graph.arcs().select("src", "dst")
    out = arcs.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    spread = save(arcs.join(out, "src").select("src", "dst", (1.0 / F.col("out")).alias("part")), "spread")
    sinks = save(graph.vertices.select("id").join(out, F.col("id") == F.col("src"), "left_anti"), "sinks")
    start = graph.vertices.select("id", F.lit(1.0 / n).alias("score"), F.lit(1.0).alias("moved"))

    def step(state: DataFrame) -> DataFrame:
        lost = state.join(sinks, "id").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("lost"))  # one row
        got = spread.join(state, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("to")).agg(F.sum(F.col("score") * F.col("part")).alias("got"))
        new = (1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)
        return state.join(got, F.col("id") == F.col("to"), "left").join(F.broadcast(lost)).select("id", new.alias("score"), F.abs(new - F.col("score")).alias("moved"))

    out = rounds(start, step, max_iter, lambda old, new: (new.agg(F.sum("moved")).first()[0] or 0.0) < tolerance)
    return out.select("id", "score")


def personalized_pagerank(graph: Graph, seeds: DataFrame, damping: float = 0.85, max_iter: int = 1000, tolerance: float = 1e-9) -> DataFrame:
    """(id, score) with restarts at ``seeds`` (column id) only, until scores move by less than ``tolerance`` in all."""
    home = seeds.select("id").distinct().join(graph.vertices, "id", "left_semi")
    k = max(1, home.count())
    arcs = graph.arcs().select("src", "dst")
    spread = save(arcs.join(arcs.groupBy("src").agg(F.count(F.lit(1)).alias("out")), "src").select("src", "dst", (1.0 / F.col("out")).alias("part")), "spread")
    restart = save(graph.vertices.select("id").join(home.withColumn("h", F.lit(1.0 / k)), "id", "left").na.fill(0.0, ["h"]), "restart")

    def step(state: DataFrame) -> DataFrame:
        got = spread.join(state, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("to")).agg(F.sum(F.col("score") * F.col("part")).alias("got"))
        now = state.select(F.col("id").alias("at"), F.col("score").alias("old"))
        new = (1 - damping) * F.col("h") + damping * F.coalesce("got", F.lit(0.0))
        return restart.join(got, F.col("id") == F.col("to"), "left").join(now, F.col("id") == F.col("at")).select("id", new.alias("score"), F.abs(new - F.col("old")).alias("moved"))

    start = restart.select("id", F.col("h").alias("score"), F.lit(1.0).alias("moved"))
    return rounds(start, step, max_iter, lambda old, new: (new.agg(F.sum("moved")).first()[0] or 0.0) < tolerance).select("id", "score")


def hits(graph: Graph, max_iter: int = 1000, tolerance: float = 1e-6) -> DataFrame:
    """(id, hub, authority), each of length 1 in the Euclidean norm."""
    n = max(1, _n(graph))
    arcs = save(graph.arcs().select("src", "dst"), "arcs")
    start = graph.vertices.select("id", F.lit(n**-0.5).alias("hub"), F.lit(n**-0.5).alias("authority"), F.lit(1.0).alias("moved"))

    def unit(df: DataFrame, c: str) -> DataFrame:
        norm = df.agg(F.sqrt(F.sum(F.col(c) * F.col(c))).alias("norm"))
        return df.join(F.broadcast(norm)).withColumn(c, F.when(F.col("norm") > 0, F.col(c) / F.col("norm")).otherwise(0.0)).drop("norm")

    def step(state: DataFrame) -> DataFrame:
        a = arcs.join(state, F.col("src") == F.col("id")).groupBy("dst").agg(F.sum("hub").alias("a"))
        a = unit(state.join(a, F.col("id") == F.col("dst"), "left").select("id", F.coalesce("a", F.lit(0.0)).alias("a")), "a")
        h = arcs.join(a, F.col("dst") == F.col("id")).groupBy("src").agg(F.sum("a").alias("h"))
        h = unit(a.join(h, F.col("id") == F.col("src"), "left").select("id", "a", F.coalesce("h", F.lit(0.0)).alias("h")), "h")
        return state.join(h, "id").select("id", F.col("h").alias("hub"), F.col("a").alias("authority"), (F.pow(F.col("h") - F.col("hub"), 2) + F.pow(F.col("a") - F.col("authority"), 2)).alias("moved"))

    out = rounds(start, step, max_iter, lambda old, new: (new.agg(F.sum("moved")).first()[0] or 0.0) ** 0.5 < tolerance)
    return out.select("id", "hub", "authority")


def eigenvector(graph: Graph, max_iter: int = 1000, tolerance: float = 1e-4) -> DataFrame:
    """(id, score) of unit length, from incoming arcs; the shifted iteration x + A x cannot oscillate on bipartite graphs."""
    n = max(1, _n(graph))
    arcs = save(graph.arcs().select("src", "dst"), "arcs")
    start = graph.vertices.select("id", F.lit(n**-0.5).alias("score"), F.lit(1.0).alias("moved"))

    def step(state: DataFrame) -> DataFrame:
        got = arcs.join(state, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("to")).agg(F.sum("score").alias("got"))
        new = state.join(got, F.col("id") == F.col("to"), "left").select("id", "score", (F.col("score") + F.coalesce("got", F.lit(0.0))).alias("x"))
        norm = new.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
        x = F.col("x") / F.col("norm")
        return new.join(F.broadcast(norm)).select("id", x.alias("score"), F.pow(x - F.col("score"), 2).alias("moved"))

    return rounds(start, step, max_iter, lambda old, new: (new.agg(F.sum("moved")).first()[0] or 0.0) ** 0.5 < tolerance).select("id", "score")


def katz(graph: Graph, alpha: float = 0.1, beta: float = 1.0, max_iter: int = 1000, tolerance: float = 1e-6) -> DataFrame:
    """(id, score): x = alpha * (sum over incoming arcs) + beta, not normalised."""
    arcs = save(graph.arcs().select("src", "dst"), "arcs")
    start = graph.vertices.select("id", F.lit(0.0).alias("score"), F.lit(1.0).alias("moved"))

    def step(state: DataFrame) -> DataFrame:
        got = arcs.join(state, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("to")).agg(F.sum("score").alias("got"))
        new = alpha * F.coalesce("got", F.lit(0.0)) + beta
        return state.join(got, F.col("id") == F.col("to"), "left").select("id", new.alias("score"), F.abs(new - F.col("score")).alias("moved"))

    return rounds(start, step, max_iter, lambda old, new: (new.agg(F.sum("moved")).first()[0] or 0.0) < tolerance).select("id", "score")


def alpha(graph: Graph, alpha: float = 0.1, exogenous: DataFrame | None = None, max_iter: int = 1000, tolerance: float = 1e-6) -> DataFrame:
    """(id, score): x = alpha * (sum over incoming arcs) + e, with e of (id, e), 1 by default; starts at e."""
    arcs = save(graph.arcs().select("src", "dst"), "arcs")
    outside = graph.vertices.select("id", F.lit(1.0).alias("e")) if exogenous is None else graph.vertices.select("id").join(exogenous.select("id", F.col("e").cast("double")), "id", "left").na.fill(0.0, ["e"])
    start = outside.select("id", "e", F.col("e").alias("score"), F.lit(1.0).alias("moved"))

    def step(state: DataFrame) -> DataFrame:
        got = arcs.join(state, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("to")).agg(F.sum("score").alias("got"))
        new = alpha * F.coalesce("got", F.lit(0.0)) + F.col("e")
        return state.join(got, F.col("id") == F.col("to"), "left").select("id", "e", new.alias("score"), F.abs(new - F.col("score")).alias("moved"))

    return rounds(start, step, max_iter, lambda old, new: (new.agg(F.sum("moved")).first()[0] or 0.0) < tolerance).select("id", "score")


def settle(graph: Graph, state: DataFrame, step, changed: str = "new") -> DataFrame:
    """Any user-defined vertex program: rounds of ``step`` until no row is marked."""
    return fixpoint(state, step, changed)
