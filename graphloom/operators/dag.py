"""Directed acyclic graphs: one level a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.graph import Graph
from graphloom.plans import save
from graphloom.plans.fixpoint import fixpoint


def _jumps(arcs: DataFrame, waits: DataFrame) -> DataFrame:
    """(id, root, k): of a vertex with one arc in, the first vertex above it that has none or several, k arcs away; of others, themselves."""
    state = waits.where("waits = 1").join(arcs.withColumnRenamed("dst", "id"), "id").select("id", F.col("src").alias("root"), F.lit(1).cast("long").alias("k"), F.lit(True).alias("new"))

    def step(state: DataFrame) -> DataFrame:
        up = state.select(F.col("id").alias("root"), F.col("root").alias("top"), F.col("k").alias("more"))
        both = state.join(up, "root", "left")
        return both.select("id", F.coalesce("top", "root").alias("root"), (F.col("k") + F.coalesce("more", F.lit(0))).alias("k"), F.col("top").isNotNull().alias("new"))

    limit = state.count().bit_length() + 2
    state = fixpoint(state, step, "new", limit, partial=True)
    if not state.where("new").isEmpty():
        raise ValueError("the graph has a cycle")
    return state.select("id", "root", "k").unionByName(waits.where("waits <> 1").select("id", F.col("id").alias("root"), F.lit(0).cast("long").alias("k")))


def generations(graph: Graph) -> DataFrame:
    """(id, generation): the most arcs on a path that ends at the vertex; ValueError if there is a cycle.

    Vertices with one arc in hang on the vertex above them, found by pointer
    doubling, so chains and trees take as many rounds as their depth has bits;
    only vertices with several arcs in are settled level by level.
    """
    if not graph.directed:
        raise ValueError("an undirected graph has no topological order")
    arcs = save(graph.edges.select("src", "dst").distinct(), "arcs")
    into = arcs.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("waits"))
    waits = save(graph.vertices.select("id").distinct().join(into, "id", "left").na.fill(0, ["waits"]), "waits")
    jumps = save(_jumps(arcs, waits), "jumps")
    start = waits.where("waits <> 1").select("id", "waits", F.when(F.col("waits") == 0, F.lit(0).cast("long")).alias("generation"), (F.col("waits") == 0).alias("new"))
    several = waits.where("waits > 1").select(F.col("id").alias("dst"))
    long_arcs = save(arcs.join(several, "dst").join(jumps.withColumnRenamed("id", "src"), "src").select("root", "dst", (F.col("k") + 1).alias("far")), "arcs")
    if long_arcs.isEmpty():
        settled = start
    else:
        start = start.withColumn("least", F.lit(0).cast("long"))

        def step(state: DataFrame) -> DataFrame:
            freed = state.where("new").select(F.col("id").alias("root"), "generation").join(long_arcs, "root").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("freed"), F.max(F.col("generation") + F.col("far")).alias("g"))
            both = state.join(freed, "id", "left")
            left, least = F.col("waits") - F.coalesce("freed", F.lit(0)), F.greatest("least", F.coalesce("g", F.lit(0)))
            ready = F.col("generation").isNull() & (left == 0)
            return both.select("id", left.alias("waits"), F.when(ready, least).otherwise(F.col("generation")).alias("generation"), ready.alias("new"), least.alias("least"))

        settled = fixpoint(start, step, "new", 1_000_000)
        if not settled.where("generation is null").isEmpty():
            raise ValueError("the graph has a cycle")
    tops = settled.select(F.col("id").alias("root"), "generation")
    return jumps.join(tops, "root").select("id", (F.col("generation") + F.col("k")).alias("generation"))


def descendants(graph: Graph, source: object) -> DataFrame:
    """(id) of all vertices that can be reached from ``source``, itself not."""
    from graphloom.operators.paths import bfs

    return bfs(graph, graph.vertices.where(F.col("id") == source).select("id")).where("depth > 0").select("id")


def ancestors(graph: Graph, target: object) -> DataFrame:
    """(id) of all vertices that reach ``target``, itself not."""
    from graphloom.operators.transforms import transpose

    return descendants(transpose(graph), target)


def lowest_common_ancestors(graph: Graph, pairs: DataFrame) -> DataFrame:
    """(a, b, lca): the common ancestors of a and b from which no other common ancestor can be reached; a vertex counts as above itself.

    Lines of ancestors are gathered for the vertices asked only.
    """
    from graphloom.plans.fixpoint import spread

    arcs = save(graph.edges.select("src", "dst").distinct(), "arcs")
    asked = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()

    def step(front: DataFrame) -> DataFrame:
        return front.join(arcs, F.col("above") == F.col("dst")).select("id", F.col("src").alias("above")).distinct()

    lines = spread(asked.select("id", F.col("id").alias("above")), step, ["id", "above"])
    a, b = lines.select(F.col("id").alias("a"), "above"), lines.select(F.col("id").alias("b"), "above")
    common = save(pairs.distinct().join(a, "a").join(b, ["b", "above"]).select("a", "b", "above"), "common")
    # a common ancestor with an arc to another one is not lowest; every path between two of them runs through such vertices
    higher = common.join(arcs, F.col("above") == F.col("src")).join(common.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("above").alias("dst")), "dst").where("a = x and b = y").select("a", "b", "above")
    return common.join(higher, ["a", "b", "above"], "left_anti").select("a", "b", F.col("above").alias("lca"))


def has_cycle(graph: Graph) -> DataFrame:
    """One row (has_cycle); for undirected graphs a component with as many edges as vertices has one."""
    if graph.directed:
        try:
            generations(graph)
            found = False
        except ValueError:
            found = True
        return graph.spark.range(1).select(F.lit(found).alias("has_cycle"))
    from graphloom.operators.connectivity import weak_components

    n = graph.vertices.agg(F.count(F.lit(1)).alias("v")).join(graph.edges.agg(F.count(F.lit(1)).alias("e"))).join(weak_components(graph).agg(F.count_distinct("component").alias("c")))
    return n.select((F.col("e") > F.col("v") - F.col("c")).alias("has_cycle"))


def topological_order(graph: Graph) -> DataFrame:
    """(id, position): by generation, then id."""
    from graphloom.plans import running_total

    one = generations(graph).withColumn("g", F.lit(0))
    return running_total(one, ["g"], [F.col("generation"), F.col("id")], F.lit(1).cast("long"), "position").select("id", "position")


def _propagate(graph: Graph, start: DataFrame, best: str, max_rounds: int = 100_000) -> DataFrame:
    """(id, value) over an acyclic graph, from (id, value) along weights."""
    arcs = save(graph.edges.select("src", "dst", F.coalesce("weight", F.lit(1)).cast("double").alias("weight")), "arcs")
    pick = getattr(F, best)

    def step(state: DataFrame) -> DataFrame:
        sent = state.where("new").join(arcs, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), (F.col("value") + F.col("weight")).alias("value"), F.lit(None).cast("double").alias("old"))
        both = sent.unionByName(state.select("id", "value", F.col("value").alias("old"))).groupBy("id").agg(pick("value").alias("value"), F.max("old").alias("old"))
        return both.select("id", "value", (F.col("old").isNull() | (F.col("old") != F.col("value"))).alias("new"))

    return fixpoint(start.select("id", F.col("value").cast("double").alias("value"), F.lit(True).alias("new")), step, "new", max_rounds).drop("new")


def longest_distances(graph: Graph) -> DataFrame:
    """(id, value): the largest weight of a path that ends at the vertex and starts anywhere; weights of 0 or more."""
    generations(graph)  # raises on cycles
    return _propagate(graph, graph.vertices.select("id", F.lit(0.0).alias("value")), "max")


def longest_path_length(graph: Graph) -> DataFrame:
    return longest_distances(graph).agg(F.coalesce(F.max("value"), F.lit(0.0)).alias("length"))


def distances_from(graph: Graph, source: object) -> DataFrame:
    return _propagate(graph, graph.vertices.where(F.col("id") == source).select("id", F.lit(0.0).alias("value")), "min").select("id", F.col("value").alias("dist"))


def path_counts(graph: Graph, source: object) -> DataFrame:
    """(id, n_paths) of paths from the source, itself with 1; counts add up level by level."""
    generations(graph)
    arcs = graph.edges.select("src", "dst").distinct()
    start = graph.vertices.where(F.col("id") == source).select("id", F.lit(1).cast("long").alias("n"), F.lit(0).alias("hops"), F.lit(True).alias("new"))

    def step(state: DataFrame) -> DataFrame:
        more = state.where("new").join(arcs, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id"), (F.col("hops") + 1).alias("hops")).agg(F.sum("n").alias("n"))
        return state.withColumn("new", F.lit(False)).unionByName(more.withColumn("new", F.lit(True)))

    return fixpoint(start, step, "new").groupBy("id").agg(F.sum("n").alias("n_paths"))


def sources(graph: Graph) -> DataFrame:
    return graph.vertices.select("id").join(graph.edges.select(F.col("dst").alias("id")), "id", "left_anti")


def sinks(graph: Graph) -> DataFrame:
    return graph.vertices.select("id").join(graph.edges.select(F.col("src").alias("id")), "id", "left_anti")


def chain_ranks(links: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Positions along ordered chains, for graphs that are disjoint paths."""
    return links.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
