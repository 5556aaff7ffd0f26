"""Transformations of whole graphs, each one declarative plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.graph import Graph, canonical, from_edges
from graphloom.plans.fixpoint import fixpoint


def transpose(graph: Graph) -> Graph:
    if not graph.directed:
        return graph
    return graph.with_edges(graph.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def to_directed(graph: Graph) -> Graph:
    """Every undirected edge becomes two arcs."""
    edges = graph.edges
    if not graph.directed:
        edges = edges.unionByName(edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return graph.with_edges(edges, directed=True)


def to_undirected(graph: Graph, resolve: str = "max") -> Graph:
    """Arcs in both directions become one edge, their weights joined by ``resolve`` (min, max or sum)."""
    edges = canonical(graph.edges).groupBy("src", "dst").agg(getattr(F, resolve)("weight").alias("weight"))
    return graph.with_edges(edges, directed=False)


def add_self_loops(graph: Graph, weight: float = 1) -> Graph:
    """A loop at every vertex that has none."""
    loops = graph.vertices.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(weight).cast(graph.edges.schema["weight"].dataType).alias("weight"))
    return graph.with_edges(graph.edges.unionByName(loops.join(graph.edges, ["src", "dst"], "left_anti")))


def remove_self_loops(graph: Graph) -> Graph:
    return graph.with_edges(graph.edges.where("src <> dst"))


def map_nodes(graph: Graph, **columns: Column) -> Graph:
    """New vertex columns as expressions of the old ones (and of id)."""
    return replace(graph, vertices=graph.vertices.withColumns(columns))


def map_edges(graph: Graph, weight: Column) -> Graph:
    """New weights as an expression of src, dst and weight."""
    return graph.with_edges(graph.edges.withColumn("weight", weight))


def subgraph(graph: Graph, ids: DataFrame) -> Graph:
    """Induced by the vertices in ``ids`` (column id)."""
    ids = ids.select("id").distinct()
    edges = graph.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return replace(graph, vertices=graph.vertices.join(ids, "id", "left_semi"), edges=edges.select("src", "dst", "weight"))


def filter_nodes(graph: Graph, keep: Column) -> Graph:
    return subgraph(graph, graph.vertices.where(keep).select("id"))


def filter_edges(graph: Graph, keep: Column) -> Graph:
    return graph.with_edges(graph.edges.where(keep))


def relabel(graph: Graph, names: DataFrame) -> Graph:
    """Rename ids by (id, new); vertices without a new name keep theirs; vertices of one new name merge."""
    of = lambda c: F.coalesce(f"new_{c}", c).alias(c)
    name = lambda c: names.select(F.col("id").alias(c), F.col("new").alias(f"new_{c}"))
    edges = graph.edges.join(name("src"), "src", "left").join(name("dst"), "dst", "left").select(of("src"), of("dst"), "weight")
    vertices = graph.vertices.join(names, "id", "left").withColumn("id", F.coalesce("new", "id")).drop("new").dropDuplicates(["id"])
    return from_edges(edges, graph.directed, vertices=vertices)


def ranked_ids(graph: Graph) -> DataFrame:
    """(id, new): new ids 0, 1, ... in the order of the old ones."""
    from graphloom.plans import running_total

    one = graph.vertices.select("id").withColumn("g", F.lit(0))
    return running_total(one, ["g"], [F.col("id")], F.lit(1).cast("long"), "new").select("id", "new")


def normalize_ids(graph: Graph) -> Graph:
    return relabel(graph, ranked_ids(graph))


def complement(graph: Graph) -> Graph:
    """All pairs of different vertices that are no edge, weight 1; its size is quadratic by definition.

    A vertex and its own edges meet lists of some thousand ids, so the pairs are
    made where they are wanted and never shuffled.
    """
    from graphloom.plans import save, shuffle_partitions

    ids = save(graph.vertices.select("id").distinct(), "ids")
    n = ids.count()
    lists = ids.groupBy(F.pmod(F.xxhash64("id"), F.lit(n // 4096 + 1)).alias("list")).agg(F.collect_list("id").alias("ids")).select("ids")
    taken = graph.edges.groupBy("src").agg(F.collect_list("dst").alias("taken"))
    rows = ids.select(F.col("id").alias("src")).join(taken, "src", "left").repartition(max(shuffle_partitions(graph.spark), min(10_000, n * n >> 27)), "src")
    free = F.when(F.col("taken").isNull(), F.col("ids")).otherwise(F.array_except("ids", "taken"))
    wanted = F.filter(free, lambda x: x != F.col("src") if graph.directed else x > F.col("src"))
    pairs = rows.crossJoin(F.broadcast(lists)).select("src", F.explode(wanted).alias("dst"))
    return graph.with_edges(pairs.withColumn("weight", F.lit(1).cast(graph.edges.schema["weight"].dataType)))


def contract(graph: Graph, into: object, gone: object, combine: str = "sum") -> Graph:
    """Merge vertex ``gone`` into ``into``; the edge between them goes, parallel edges combine."""
    to = lambda c: F.when(F.col(c) == gone, F.lit(into)).otherwise(F.col(c)).alias(c)
    one = F.col("src").isin(into, gone) & F.col("dst").isin(into, gone) & (F.col("src") != F.col("dst"))
    edges = graph.edges.where(~one).select(to("src"), to("dst"), "weight")
    return from_edges(edges, graph.directed, combine, graph.vertices.where(F.col("id") != gone))


def quotient(graph: Graph, blocks: DataFrame, combine: str = "sum") -> Graph:
    """One vertex for each block of (id, block); unmapped vertices are blocks of their own; edges inside a block go."""
    of = graph.vertices.select("id").join(blocks, "id", "left").select("id", F.coalesce("block", "id").alias("block"))
    edges = graph.edges.join(of.select(F.col("id").alias("src"), F.col("block").alias("a")), "src").join(of.select(F.col("id").alias("dst"), F.col("block").alias("b")), "dst")
    edges = edges.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight")
    return from_edges(edges, graph.directed, combine, of.select(F.col("block").alias("id")).distinct())


def ego_graph(graph: Graph, center: object, radius: int = 1, all_directions: bool = False) -> Graph:
    """Induced by the vertices within ``radius`` steps of ``center``."""
    arcs = graph.both_ways() if all_directions else graph.arcs()
    near = graph.vertices.where(F.col("id") == center).select("id")
    for _ in range(radius):
        near = near.unionByName(arcs.join(near.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))).distinct()
    return subgraph(graph, near)


def closure_pairs(graph: Graph) -> DataFrame:
    """(src, dst): dst can be reached from src by one arc or more, src <> dst; doubles the path length each round."""
    arcs = graph.arcs().where("src <> dst").select("src", "dst").distinct().withColumn("new", F.lit(True))

    def step(state: DataFrame) -> DataFrame:
        a = state.select("src", F.col("dst").alias("m"), F.col("new").alias("na"))
        b = state.select(F.col("src").alias("m"), "dst", F.col("new").alias("nb"))
        more = a.join(b, "m").where("(na or nb) and src <> dst").select("src", "dst").distinct().join(state, ["src", "dst"], "left_anti")
        return state.select("src", "dst", F.lit(False).alias("new")).unionByName(more.withColumn("new", F.lit(True)))

    return fixpoint(arcs, step, "new").select("src", "dst")


def transitive_closure(graph: Graph) -> Graph:
    """With an arc of weight 1 to everything that can be reached; arcs that exist keep their weight, no loops are added."""
    new = closure_pairs(graph).join(graph.edges, ["src", "dst"], "left_anti").withColumn("weight", F.lit(1).cast(graph.edges.schema["weight"].dataType))
    return graph.with_edges(graph.edges.unionByName(new))


def transitive_reduction(graph: Graph) -> Graph:
    """The least arcs with the same reachability; of a graph with a cycle: ValueError."""
    reach = closure_pairs(graph)
    if not graph.edges.where("src = dst").isEmpty() or not reach.join(reach.select(F.col("src").alias("dst"), F.col("dst").alias("src")), ["src", "dst"], "left_semi").isEmpty():
        raise ValueError("the graph has a cycle")
    long_way = graph.edges.select("src", F.col("dst").alias("m")).join(reach.select(F.col("src").alias("m"), "dst"), "m").select("src", "dst").distinct()
    return graph.with_edges(graph.edges.join(long_way, ["src", "dst"], "left_anti").select("src", "dst", "weight"))


def apply_columns(graph: Graph, change: Callable[[DataFrame], DataFrame]) -> Graph:
    """Any DataFrame change of the vertices that keeps id."""
    return replace(graph, vertices=change(graph.vertices))


def heaviest_arcs(graph: Graph, k: int) -> DataFrame:
    """(src, dst, weight, rank): each vertex's k heaviest outgoing arcs, ties by dst."""
    by = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    return graph.arcs().withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
