"""Structural tests, colourings, independent sets, matchings and spanning trees, as rounds of local choices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators.connectivity import strong_components, weak_components
from graphloom.operators.paths import bfs
from graphloom.plans import drop_saved, save


def counts(graph: Graph) -> DataFrame:
    """One row: n_nodes, n_edges, n_loops, n_components, and the least and largest degree."""
    from graphloom.operators.model import degrees

    v = graph.vertices.agg(F.count(F.lit(1)).alias("n_nodes"))
    e = graph.edges.agg(F.count(F.lit(1)).alias("n_edges"), F.coalesce(F.sum((F.col("src") == F.col("dst")).cast("long")), F.lit(0)).alias("n_loops"))
    c = weak_components(graph).agg(F.count_distinct("component").alias("n_components"))
    d = degrees(graph).agg(F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"))
    return v.join(e).join(c).join(d)


def predicates(graph: Graph) -> DataFrame:
    """One row of tests: is_empty, is_complete, is_regular, is_connected, is_forest, is_tree (undirected); is_branching and is_arborescence for directed graphs."""
    n = F.col("n_nodes")
    c = counts(graph)
    empty, regular = n == 0, (n == 0) | (F.col("min_degree") == F.col("max_degree"))
    pairs = n * (n - 1) if graph.directed else n * (n - 1) / 2
    complete = (n <= 1) | ((F.col("n_loops") == 0) & (F.col("n_edges") == pairs))
    if not graph.directed:
        forest = F.col("n_edges") == n - F.col("n_components")
        return c.select(empty.alias("is_empty"), complete.alias("is_complete"), regular.alias("is_regular"), (F.col("n_components") <= 1).alias("is_connected"), forest.alias("is_forest"), (forest & (F.col("n_components") == 1)).alias("is_tree"))
    into = graph.edges.groupBy("dst").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("most_in"))
    strong = strong_components(graph).agg(F.count_distinct("component").alias("n_strong"))
    branching = (F.col("most_in") <= 1) & (F.col("n_edges") == n - F.col("n_components"))
    return c.join(into).join(strong).select(empty.alias("is_empty"), complete.alias("is_complete"), regular.alias("is_regular"), (F.col("n_strong") <= 1).alias("is_connected"), branching.alias("is_branching"), (branching & (F.col("n_components") == 1)).alias("is_arborescence"))


def bipartition(graph: Graph) -> DataFrame:
    """(id, side): sides by the parity of the distance from each component's smallest vertex, whatever the direction."""
    both = Graph(graph.vertices, graph.edges, False)
    roots = weak_components(graph).select(F.col("component").alias("id")).distinct()
    return bfs(both, roots).select("id", (F.col("depth") % 2).alias("side"))


def is_bipartite(graph: Graph) -> DataFrame:
    side = save(bipartition(graph), "sides")
    a, b = side.select(F.col("id").alias("src"), F.col("side").alias("a")), side.select(F.col("id").alias("dst"), F.col("side").alias("b"))
    return graph.edges.join(a, "src").join(b, "dst").agg((F.coalesce(F.sum((F.col("a") == F.col("b")).cast("long")), F.lit(0)) == 0).alias("is_bipartite"))


def _neighbors(graph: Graph) -> DataFrame:
    return save(graph.both_ways().where("src <> dst").select("src", "dst").distinct(), "arcs")


def maximal_independent_set(graph: Graph, seed: int = 0) -> DataFrame:
    """(id) by rounds of random local minima; vertices with loops may be in it."""
    arcs, left, chosen, turn = _neighbors(graph), graph.vertices.select("id").distinct(), None, 0
    left = save(left, "left")
    while not left.isEmpty():
        turn += 1
        value = F.struct(F.xxhash64(F.lit(seed + turn), "id"), "id")
        ranked = left.select("id", value.alias("r"))
        least = arcs.join(ranked.withColumnsRenamed({"id": "dst"}), "dst").groupBy(F.col("src").alias("id")).agg(F.min("r").alias("m"))
        won = save(ranked.join(least, "id", "left").where("m is null or r < m").select("id"), "won")
        chosen = won if chosen is None else chosen.unionByName(won)
        gone = won.unionByName(arcs.join(won.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"))).distinct()
        old, left = left, save(left.join(gone, "id", "left_anti"), "left")
        arcs = save(arcs.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"), "arcs")
        drop_saved(old)
    return chosen if chosen is not None else graph.vertices.select("id").limit(0)


def greedy_coloring(graph: Graph, seed: int = 0) -> DataFrame:
    """(id, color) with no two neighbours alike and at most degree + 1 colours: vertices of largest degree choose first, in parallel where no neighbour waits."""
    arcs = _neighbors(graph)
    d = arcs.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d"))
    rank = F.struct(-F.coalesce("d", F.lit(0)), F.xxhash64(F.lit(seed), "id"), F.col("id")).alias("r")
    ranked = save(graph.vertices.select("id").distinct().join(d, "id", "left").select("id", rank), "ranked")
    done, left = None, ranked
    while not left.isEmpty():
        least = arcs.join(left.select(F.col("id").alias("dst"), "r"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("r").alias("m"))
        ready = left.join(least, "id", "left").where("m is null or r < m").select("id")
        if done is None:
            colored = ready.select("id", F.lit(0).alias("color"))
        else:
            used = arcs.join(done.select(F.col("id").alias("dst"), "color"), "dst").join(ready.withColumnRenamed("id", "src"), "src", "left_semi").groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("color")).alias("used"))
            free = F.coalesce(F.array_min(F.array_except(F.sequence(F.lit(0), F.size("used")), F.col("used"))), F.lit(0)).cast("int")
            colored = ready.join(used, "id", "left").select("id", F.when(F.col("used").isNull(), 0).otherwise(free).alias("color"))
        colored = save(colored, "colored")
        done = colored if done is None else save(done.unionByName(colored), "done")
        left = save(left.join(colored, "id", "left_anti"), "left")
    return done if done is not None else graph.vertices.select("id", F.lit(0).alias("color")).limit(0)


def maximal_matching(graph: Graph, heaviest: bool = True) -> DataFrame:
    """(src, dst, weight): rounds in which edges that are the best around both ends are taken; by weight it is within half of the optimum."""
    left = save(graph.edges.where("src <> dst").select("src", "dst", F.coalesce("weight", F.lit(1)).alias("weight")), "left")
    found = None
    while not left.isEmpty():
        value = F.struct((-F.col("weight") if heaviest else F.col("weight")).alias("w"), F.xxhash64("src", "dst").alias("h"), "src", "dst")
        ranked = left.withColumn("r", value)
        least = ranked.select(F.col("src").alias("id"), "r").unionByName(ranked.select(F.col("dst").alias("id"), "r")).groupBy("id").agg(F.min("r").alias("m"))
        best = ranked.join(least.select(F.col("id").alias("src"), F.col("m").alias("ma")), "src").join(least.select(F.col("id").alias("dst"), F.col("m").alias("mb")), "dst")
        taken = save(best.where("r = ma and r = mb").select("src", "dst", "weight"), "taken")
        found = taken if found is None else found.unionByName(taken)
        ends = taken.select(F.col("src").alias("id")).unionByName(taken.select(F.col("dst").alias("id")))
        left = save(left.join(ends.withColumnRenamed("id", "src"), "src", "left_anti").join(ends.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst", "weight"), "left")
    return found if found is not None else left


def stable_marriage(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left, right) pairs, the left side proposing; preferences are rows (left, right, rank) and (right, left, rank).

    A round lets every free left vertex propose to its next choice and every
    right vertex keep its best offer, as in deferred acceptance.
    """
    ranks = right.select("right", "left", F.col("rank").alias("liking"))
    both = save(left.join(ranks, ["left", "right"]).select("left", "right", "rank", "liking"), "choices")
    state = both.groupBy("left").agg(F.min("rank").alias("at")).withColumn("new", F.lit(True))
    state = save(state, "offers")
    while True:
        offers = state.join(both, "left").where("rank = at")
        kept = offers.groupBy("right").agg(F.min_by("left", F.struct("liking", "left")).alias("left"))
        refused = offers.join(kept, ["left", "right"], "left_anti").select("left", "at")
        following = refused.join(both, "left").where("rank > at").groupBy("left").agg(F.min("rank").alias("at"))
        if refused.isEmpty():
            return kept.select("left", "right")
        state = save(kept.join(state, "left").select("left", "at", "new").unionByName(following.withColumn("new", F.lit(True))), "offers")


def spanning_forest(graph: Graph, maximum: bool = False) -> DataFrame:
    """(src, dst, weight) of a minimum (or maximum) spanning forest by Boruvka's rounds, ties by (src, dst).

    Each round picks the best edge out of every component and merges along
    them, which at least halves the components.
    """
    if graph.directed:
        raise ValueError("spanning forests are defined for undirected graphs")
    from graphloom.plans import connected_components

    edges = graph.edges.where("src <> dst").select("src", "dst", F.coalesce("weight", F.lit(1)).alias("weight"))
    live = save(edges.select("src", "dst", "weight", F.col("src").alias("a"), F.col("dst").alias("b")), "live")
    found = None
    while not live.isEmpty():
        value = F.struct((-F.col("weight") if maximum else F.col("weight")).alias("w"), "src", "dst")
        ends = live.select(F.col("a").alias("c"), value.alias("r"), "a", "b", "weight").unionByName(live.select(F.col("b").alias("c"), value.alias("r"), "a", "b", "weight"))
        best = ends.groupBy("c").agg(F.min(F.struct("r", "a", "b", "weight")).alias("x"))
        picked = save(best.select(F.col("x.r.src").alias("src"), F.col("x.r.dst").alias("dst"), F.col("x.weight").alias("weight"), F.col("x.a").alias("a"), F.col("x.b").alias("b")).distinct(), "picked")
        one = picked.select("src", "dst", "weight")
        found = one if found is None else found.unionByName(one)
        comps = save(connected_components(picked, "a", "b"), "merged")
        to = lambda c: F.coalesce(f"n{c}", c).alias(c)
        old = live
        live = save(live.join(comps.select(F.col("id").alias("a"), F.col("component").alias("na")), "a", "left").join(comps.select(F.col("id").alias("b"), F.col("component").alias("nb")), "b", "left").select("src", "dst", "weight", to("a"), to("b")).where("a <> b"), "live")
        drop_saved(old)
    return found if found is not None else edges.limit(0)


def wl_hashes(graph: Graph, rounds: int = 3) -> DataFrame:
    """(id, label): Weisfeiler-Lehman labels; the start is the degree, each round hashes the sorted labels around."""
    arcs = _neighbors(graph)
    d = arcs.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d"))
    label = graph.vertices.select("id").join(d, "id", "left").select("id", F.md5(F.coalesce("d", F.lit(0)).cast("string")).alias("label"))
    for _ in range(rounds):
        around = arcs.join(label.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.concat_ws("|", F.sort_array(F.collect_list("label"))).alias("around"))
        label = save(label.join(around, "id", "left").select("id", F.md5(F.concat("label", F.lit(":"), F.coalesce("around", F.lit("")))).alias("label")), "labels")
    return label


def wl_equivalent(a: Graph, b: Graph, rounds: int = 3) -> DataFrame:
    """One row: the graphs have the same labels equally often. Equal graphs always are; the reverse need not hold."""
    ha, hb = (wl_hashes(g, rounds).groupBy("label").agg(F.count(F.lit(1)).alias("n")) for g in (a, b))
    odd = ha.exceptAll(hb).unionByName(hb.exceptAll(ha)).agg(F.count(F.lit(1)).alias("odd"))
    return odd.select((F.col("odd") == 0).alias("wl_equivalent"))


def eulerian(graph: Graph) -> DataFrame:
    """One row (has_circuit, has_path) by degrees and by the connectivity of the vertices that have edges."""
    from graphloom.operators.model import degrees

    d = degrees(graph)
    comps = weak_components(graph).join(d.where("degree > 0").select("id"), "id", "left_semi").agg(F.count_distinct("component").alias("c"))
    if graph.directed:
        gap = F.col("out_degree") - F.col("in_degree")
        odd = d.agg(F.sum((gap != 0).cast("long")).alias("odd"), F.sum((gap == 1).cast("long")).alias("start"), F.sum((gap == -1).cast("long")).alias("end"))
        path = (F.col("odd") == 0) | ((F.col("odd") == 2) & (F.col("start") == 1) & (F.col("end") == 1))
    else:
        odd = d.agg(F.sum(F.col("degree") % 2).alias("odd"))
        path = F.col("odd").isin(0, 2)
    return odd.join(comps).select(((F.col("odd") == 0) & (F.col("c") <= 1)).alias("has_circuit"), (path & (F.col("c") <= 1)).alias("has_path"))
