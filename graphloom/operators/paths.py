"""Traversal and shortest paths as rounds over a frontier.

Every round joins only what changed in the round before with the arcs. Searches
by hops append the vertices that a round finds and never write the others
again; weighted searches write the table of distances anew in each round, as
distances may fall again. Searches from many sources go in blocks instead (see
``searches``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.semirings import MIN_PLUS, Semiring
from graphloom.graph import Graph
from graphloom.operators.searches import search
from graphloom.plans import drop_saved, running_total, save
from graphloom.plans.fixpoint import fixpoint, rounds, spread


def bfs(graph: Graph, sources: DataFrame, max_depth: int | None = None, max_rounds: int = 100_000) -> DataFrame:
    """(id, depth, parent) of all vertices reachable from ``sources`` (column id); the parent is the smallest possible one."""
    arcs = graph.arcs().select("src", "dst").distinct()
    start = sources.select("id").distinct().join(graph.vertices, "id", "left_semi")
    first = start.select("id", F.lit(0).alias("depth"), F.lit(None).cast(graph.vertices.schema["id"].dataType).alias("parent"))

    def step(front: DataFrame) -> DataFrame:
        near = front.select(F.col("id").alias("src"), "depth").join(arcs, "src")
        return near.groupBy(F.col("dst").alias("id")).agg(F.min(F.col("depth") + 1).alias("depth"), F.min("src").alias("parent"))

    return spread(first, step, ["id"], max_rounds if max_depth is None else max_depth, max_depth is not None)


def bidirectional_distance(graph: Graph, source: object, target: object) -> DataFrame:
    """One row (hops) of a shortest path, by searches from both ends that take turns, the smaller frontier first; null without a path."""
    arcs = save(graph.arcs().select("src", "dst").distinct(), "arcs")
    back = arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    one = lambda x: graph.vertices.where(F.col("id") == x).select("id", F.lit(0).alias("depth"))
    sides = [(arcs, save(one(source), "near"), save(one(source), "front"), 0), (back, save(one(target), "near"), save(one(target), "front"), 0)]
    best = None
    while True:
        met = sides[0][1].join(sides[1][1].withColumnRenamed("depth", "other"), "id").agg(F.min(F.col("depth") + F.col("other")).alias("hops")).first()["hops"]
        best = met if met is not None else best
        sizes = [x[2].count() for x in sides]
        if not all(sizes) or best is not None and best <= sides[0][3] + sides[1][3]:
            return graph.spark.range(1).select(F.lit(best).cast("long").alias("hops"))
        i = int(sizes[1] < sizes[0])
        along, seen, front, depth = sides[i]
        new = save(front.select(F.col("id").alias("src")).join(along, "src").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("depth", F.lit(depth + 1)), "front")
        sides[i] = (along, seen.unionByName(new), new, depth + 1)


def sssp(graph: Graph, sources: DataFrame, semiring: Semiring = MIN_PLUS, max_rounds: int = 100_000) -> DataFrame:
    """(source, id, dist) for every source (column id) and every vertex it reaches, in any idempotent semiring.

    Raises ValueError when distances still improve after as many rounds as
    there are vertices, which a cycle that improves forever causes.
    """
    arcs = graph.arcs().select("src", "dst", F.col("weight").cast("double").alias("weight"))
    n = graph.vertices.count()
    start = sources.select("id").distinct().join(graph.vertices, "id", "left_semi")
    dist = start.select(F.col("id").alias("source"), "id", F.lit(semiring.one).alias("dist"), F.lit(True).alias("new"))

    def step(state: DataFrame) -> DataFrame:
        front = state.where("new").select("source", F.col("id").alias("src"), "dist")
        reached = front.join(arcs, "src").select("source", F.col("dst").alias("id"), semiring.extend(F.col("dist"), F.col("weight")).alias("dist"), F.lit(None).cast("double").alias("old"))
        both = reached.unionByName(state.select("source", "id", "dist", F.col("dist").alias("old")))
        best = both.groupBy("source", "id").agg(semiring.best("dist").alias("dist"), F.max("old").alias("old"))
        return best.select("source", "id", "dist", (F.col("old").isNull() | (F.col("old") != F.col("dist"))).alias("new"))

    limit = min(max_rounds, n + 1)
    out = fixpoint(dist, step, "new", limit, partial=True)
    if not out.where("new").isEmpty():
        raise ValueError("negative cycle" if semiring is MIN_PLUS else "distances do not settle")
    return out.drop("new")


def _vertices_of(graph: Graph, sources: DataFrame) -> DataFrame:
    return sources.select("id").distinct().join(graph.vertices, "id", "left_semi")


def distances(graph: Graph, sources: DataFrame) -> DataFrame:
    """(source, id, dist) as ``sssp`` has them, for many sources."""
    return search(graph, graph.arcs(), _vertices_of(graph, sources), "pairs", sssp)


def distance_counts(graph: Graph, sources: DataFrame, per: str = "source") -> DataFrame:
    """(source, dist, n): how many vertices each source reaches at a distance; ``per`` id: (id, dist, n) of the sources that reach a vertex, n to be summed."""
    rest = lambda g, s: sssp(g, s).groupBy(per, "dist").agg(F.count(F.lit(1)).alias("n"))
    return search(graph, graph.arcs(), _vertices_of(graph, sources), f"by_{per}", rest)


def shortest_path(graph: Graph, source: object, target: object) -> DataFrame:
    """(step, id, dist) along one shortest path of positive weights, smallest predecessor first; empty without a path."""
    spark = graph.spark
    dist = save(sssp(graph, graph.vertices.where(F.col("id") == source).select("id")).select("id", "dist"), "dist")
    arcs = graph.arcs().select("src", "dst", F.col("weight").cast("double").alias("weight"))
    d0, d1 = dist.select(F.col("id").alias("src"), F.col("dist").alias("d0")), dist.select(F.col("id").alias("dst"), F.col("dist").alias("d1"))
    tight = arcs.join(d0, "src").join(d1, "dst").where("src <> dst and d0 + weight = d1").groupBy("dst").agg(F.min("src").alias("src"))
    path = dist.where(F.col("id") == target).select("id", "dist", F.lit(0).alias("back"), F.lit(True).alias("new"))

    def step(state: DataFrame) -> DataFrame:
        before = state.where("new").select(F.col("id").alias("dst"), "back").join(tight, "dst").join(dist.withColumnRenamed("id", "src"), "src")
        return state.withColumn("new", F.lit(False)).unionByName(before.select(F.col("src").alias("id"), "dist", (F.col("back") + 1).alias("back"), F.lit(True).alias("new")))

    path = fixpoint(path, step, "new") if not path.isEmpty() else spark.createDataFrame([], path.schema)
    last = path.agg(F.max("back").alias("n"))
    return path.join(F.broadcast(last)).select((F.col("n") - F.col("back")).alias("step"), "id", "dist")


def all_pairs_hops(graph: Graph, sources: DataFrame | None = None) -> DataFrame:
    """(source, id, hops) from every source (default: all vertices) to all it reaches; as large as the answer is."""
    arcs = graph.arcs().select("src", "dst").where("src <> dst").distinct()
    found = search(graph, arcs.withColumn("weight", F.lit(1.0)), graph.vertices if sources is None else sources, "pairs", _hops_by_rounds)
    return found.select("source", "id", F.col("dist").cast("int").alias("hops"))


def _hops_by_rounds(graph: Graph, sources: DataFrame) -> DataFrame:
    arcs = graph.arcs().select("src", "dst")
    start = sources.select(F.col("id").alias("source"), "id", F.lit(0.0).alias("dist"))

    def step(front: DataFrame) -> DataFrame:
        near = front.select("source", F.col("id").alias("src"), "dist").join(arcs, "src")
        return near.select("source", F.col("dst").alias("id"), (F.col("dist") + 1).alias("dist")).distinct()

    return spread(start, step, ["source", "id"])


def johnson(graph: Graph, sources: DataFrame | None = None) -> DataFrame:
    """(source, id, dist) with negative weights, from all vertices by default; ValueError if there is a negative cycle.

    Potentials are the distances from a vertex over all others, by rounds over
    what changed. Arcs reweighted by them are never negative, so the searches
    from the sources go by buckets of one width: only rows of the lowest bucket
    that is not empty move on, and a row that has left its bucket behind is
    settled.
    """
    arcs = graph.arcs().select("src", "dst", F.col("weight").cast("double").alias("weight"))
    limit = graph.vertices.count() + 1
    start = graph.vertices.select("id", F.lit(0.0).alias("dist"), F.lit(True).alias("new"))

    def lower(state: DataFrame) -> DataFrame:
        front = state.where("new").select(F.col("id").alias("src"), "dist")
        reached = front.join(arcs, "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.col("dist") + F.col("weight")).alias("found"))
        better = F.col("found") < F.col("dist")
        return state.join(reached, "id", "left").select("id", F.when(better, F.col("found")).otherwise(F.col("dist")).alias("dist"), F.coalesce(better, F.lit(False)).alias("new"))

    h = fixpoint(start, lower, "new", limit, partial=True)
    if not h.where("new").isEmpty():
        raise ValueError("negative cycle")
    at = lambda end: h.select(F.col("id").alias(end), F.col("dist").alias(f"h{end}"))
    gaps = save(arcs.join(at("src"), "src").join(at("dst"), "dst").select("src", "dst", F.greatest(F.lit(0.0), F.col("weight") + F.col("hsrc") - F.col("hdst")).alias("weight")), "reweighted")
    dist = _by_buckets(gaps, (graph.vertices if sources is None else sources.join(graph.vertices, "id", "left_semi")).select("id").distinct())
    home = at("id").withColumnRenamed("hid", "to").join(dist, "id").join(at("source"), "source")
    return home.select("source", "id", (F.col("dist") - F.col("hsource") + F.col("to")).alias("dist"))


def _by_buckets(arcs: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, id, dist) along arcs of weights of 0 and more, by buckets as wide as the mean weight (delta stepping)."""
    width = arcs.where("weight > 0").agg(F.avg("weight")).first()[0] or 1.0
    settled, open_ = [], save(sources.select(F.col("id").alias("source"), "id", F.lit(0.0).alias("dist"), F.lit(True).alias("new")), "open")
    while not open_.isEmpty():
        end = (int(open_.agg(F.min("dist")).first()[0] // width) + 1) * width

        def step(state: DataFrame, end: float = end) -> DataFrame:
            front = state.where((F.col("dist") < end) & F.col("new")).select("source", F.col("id").alias("src"), "dist")
            reached = front.join(arcs, "src").select("source", F.col("dst").alias("id"), (F.col("dist") + F.col("weight")).alias("dist"), F.lit(None).cast("double").alias("old"))
            rows = state.select("source", "id", "dist", F.when(F.col("new") & (F.col("dist") >= end), None).otherwise(F.col("dist")).alias("old"))
            best = reached.unionByName(rows).groupBy("source", "id").agg(F.min("dist").alias("dist"), F.max("old").alias("old"))
            return best.select("source", "id", "dist", (F.col("old").isNull() | (F.col("dist") < F.col("old"))).alias("new"))

        open_ = fixpoint(open_, step, (F.col("dist") < end) & F.col("new"))
        fresh = open_
        for old in settled:  # a vertex of an earlier bucket is found again, but never nearer
            fresh = fresh.join(old.select("source", "id"), ["source", "id"], "left_anti")
        rest, done = fresh.where(F.col("dist") >= end), save(fresh.where(F.col("dist") < end).select("source", "id", "dist"), "settled")
        settled.append(done)
        if len(settled) == 16:
            whole = settled[0]
            for old in settled[1:]:
                whole = whole.unionByName(old)
            settled = [save(whole, "settled")]
        open_ = save(rest.withColumn("new", F.lit(True)), "open")
    out = settled[0] if settled else sources.select(F.col("id").alias("source"), "id", F.lit(0.0).alias("dist"))
    for old in settled[1:]:
        out = out.unionByName(old)
    return out


def distance_matrix(graph: Graph, points: DataFrame) -> DataFrame:
    """(source, id, dist) among the points of interest that are vertices."""
    found = distances(graph, points)
    if graph.vertices.join(points, "id", "left_anti").isEmpty():
        return found
    return found.join(points.select("id").distinct(), "id", "left_semi").select("source", "id", "dist")


def k_hop_counts(graph: Graph, k: int) -> DataFrame:
    """(id, n): how many other vertices lie within k hops."""
    near = rounds_within(graph, k)
    counts = near.where("source <> id").groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return graph.vertices.select("id").join(counts, "id", "left").na.fill(0, ["n"])


def rounds_within(graph: Graph, k: int) -> DataFrame:
    """(source, id, hops) for pairs at most k hops apart."""
    arcs = graph.arcs().select("src", "dst").where("src <> dst").distinct()
    start = graph.vertices.select(F.col("id").alias("source"), "id", F.lit(0).alias("hops"))

    def step(state: DataFrame) -> DataFrame:
        further = state.select("source", F.col("id").alias("src"), "hops").join(arcs, "src").select("source", F.col("dst").alias("id"), (F.col("hops") + 1).alias("hops"))
        return state.unionByName(further).groupBy("source", "id").agg(F.min("hops").alias("hops"))

    return rounds(start, step, k)


def random_walks(graph: Graph, starts: DataFrame, steps: int, seed: int) -> DataFrame:
    """(walk, step, id): a uniform walk from each start (walk, id) that ends at a vertex without successors; seeded.

    The arcs of a vertex are numbered once; a step draws a number for each walk
    and joins that arc alone, so a hub costs no more than another vertex.
    """
    arcs = graph.arcs().select("src", "dst").distinct()
    numbered = save(running_total(arcs, ["src"], [F.col("dst")], F.lit(1).cast("long"), "k", total="d"), "numbered")
    degrees = save(numbered.where("k = 0").select(F.col("src").alias("id"), "d"), "degrees")
    at = save(starts.select("walk", F.lit(0).alias("step"), "id"), "walk")
    out = at
    for i in range(1, steps + 1):
        pick = F.pmod(F.xxhash64(F.lit(seed), "walk", F.lit(i)), F.col("d")).alias("k")
        drawn = at.join(degrees, "id").select("walk", F.col("id").alias("src"), pick)
        at = save(drawn.join(numbered.select("src", "k", "dst"), ["src", "k"]).select("walk", F.lit(i).alias("step"), F.col("dst").alias("id")), "walk")
        if at.isEmpty():
            drop_saved(at)
            break
        out = out.unionByName(at)
    return out


def lowest_common_ancestors(tree: Graph, pairs: DataFrame) -> DataFrame:
    """(a, b, lca) in a tree whose arcs point from parent to child; the deepest vertex above both (each counts as above itself)."""
    up = tree.edges.select(F.col("dst").alias("id"), F.col("src").alias("above"))
    lines = save(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct().select("id", F.col("id").alias("above"), F.lit(0).alias("up"), F.lit(True).alias("new")), "lines")

    def step(state: DataFrame) -> DataFrame:
        more = state.where("new").select("id", F.col("above").alias("k"), "up").join(up.withColumnsRenamed({"id": "k"}), "k").select("id", "above", (F.col("up") + 1).alias("up"), F.lit(True).alias("new"))
        return state.withColumn("new", F.lit(False)).unionByName(more)

    lines = fixpoint(lines, step, "new")
    a, b = lines.select(F.col("id").alias("a"), "above", F.col("up").alias("ua")), lines.select(F.col("id").alias("b"), "above", F.col("up").alias("ub"))
    return pairs.join(a, "a").join(b, ["b", "above"]).groupBy("a", "b").agg(F.min_by("above", F.col("ua") + F.col("ub")).alias("lca"))
