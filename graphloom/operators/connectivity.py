"""Components, cores and reachability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators.transforms import closure_pairs
from graphloom.plans import connected_components, save
from graphloom.plans.fixpoint import fixpoint


def weak_components(graph: Graph) -> DataFrame:
    """(id, component) of every vertex, isolated ones too; direction does not matter."""
    found = connected_components(graph.edges)
    return graph.vertices.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def strong_components(graph: Graph) -> DataFrame:
    """(id, component): the component is its smallest vertex.

    Rounds of colouring: the largest id spreads forward until it settles, then
    what can reach its own colour's root within the colour is a component and
    leaves. Vertices without arcs in or out leave at once.
    """
    arcs = save(graph.arcs().where("src <> dst").select("src", "dst").distinct(), "arcs")
    todo, done = save(graph.vertices.select("id").distinct(), "todo"), None
    while True:
        # trim: no arc in or none out
        while True:
            live = arcs.select(F.col("src").alias("id")).intersect(arcs.select(F.col("dst").alias("id")))
            alone = todo.join(live, "id", "left_anti")
            single = save(alone.select("id", F.col("id").alias("component")), "single")
            if single.isEmpty():
                break
            done = single if done is None else done.unionByName(single)
            todo = save(todo.join(single, "id", "left_anti"), "todo")
            arcs = save(arcs.join(single.select(F.col("id").alias("src")), "src", "left_anti").join(single.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst"), "arcs")
        if todo.isEmpty():
            return done if done is not None else graph.vertices.select("id", F.col("id").alias("component"))

        def color(state: DataFrame, arcs: DataFrame = arcs) -> DataFrame:
            sent = state.where("new").join(arcs, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), "color", F.lit(None).cast("long").alias("old"))
            both = sent.unionByName(state.select("id", "color", F.col("color").alias("old"))).groupBy("id").agg(F.max("color").alias("color"), F.max("old").alias("old"))
            return both.select("id", "color", (F.col("color") != F.col("old")).alias("new"))

        colors = fixpoint(todo.select("id", F.col("id").alias("color"), F.lit(True).alias("new")), color, "new").select("id", "color")
        back = arcs.join(colors.select(F.col("id").alias("src"), F.col("color").alias("cs")), "src").join(colors.select(F.col("id").alias("dst"), F.col("color").alias("cd")), "dst").where("cs = cd").select(F.col("dst").alias("from"), F.col("src").alias("to"), F.col("cs").alias("color"))
        back = save(back, "back")

        def gather(state: DataFrame, back: DataFrame = back) -> DataFrame:
            more = state.where("new").select(F.col("id").alias("from")).join(back, "from").select(F.col("to").alias("id"), "color").distinct().join(state, "id", "left_anti")
            return state.select("id", "color", F.lit(False).alias("new")).unionByName(more.withColumn("new", F.lit(True)))

        members = fixpoint(colors.where("id = color").withColumn("new", F.lit(True)), gather, "new")
        least = members.groupBy("color").agg(F.min("id").alias("component"))
        found = save(members.join(least, "color").select("id", "component"), "found")
        done = found if done is None else done.unionByName(found)
        todo = save(todo.join(found, "id", "left_anti"), "todo")
        arcs = save(arcs.join(found.select(F.col("id").alias("src")), "src", "left_anti").join(found.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst"), "arcs")


def core_numbers(graph: Graph) -> DataFrame:
    """(id, core) of an undirected graph without counting loops, by rounds of the h-index of the neighbours' values.

    The value starts at the degree and falls to the core number; a round needs
    one join and one aggregate, and only numbers that fell make another one.
    """
    if graph.directed:
        raise ValueError("cores are defined for undirected graphs")
    arcs = save(graph.arcs().where("src <> dst").select("src", "dst").distinct(), "arcs")
    degree = arcs.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("core"))

    def step(state: DataFrame) -> DataFrame:
        seen = arcs.join(state.select(F.col("id").alias("dst"), F.col("core").alias("c")), "dst").groupBy(F.col("src").alias("id"), "c").agg(F.count(F.lit(1)).alias("n"))
        from pyspark.sql.window import Window

        above = seen.withColumn("at_least", F.sum("n").over(Window.partitionBy("id").orderBy(F.desc("c"))))
        h = above.groupBy("id").agg(F.max(F.least("c", "at_least")).alias("h"))
        return state.join(h, "id").select("id", F.least("core", "h").alias("core"), (F.col("h") < F.col("core")).alias("new"))

    found = fixpoint(degree.withColumn("new", F.lit(True)), step, "new").select("id", "core")
    return graph.vertices.select("id").join(found, "id", "left").na.fill(0, ["core"])


def k_core(graph: Graph, k: int) -> Graph:
    from graphloom.operators.transforms import subgraph

    return subgraph(graph, core_numbers(graph).where(F.col("core") >= k).select("id"))


def degeneracy(graph: Graph) -> DataFrame:
    return core_numbers(graph).agg(F.coalesce(F.max("core"), F.lit(0)).alias("degeneracy"))


def reachability_counts(graph: Graph) -> DataFrame:
    """(id, descendants, ancestors), neither counting the vertex itself."""
    reach = save(closure_pairs(graph), "reach")
    down = reach.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("descendants"))
    up = reach.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("ancestors"))
    return graph.vertices.select("id").join(down, "id", "left").join(up, "id", "left").na.fill(0, ["descendants", "ancestors"])


def reachability_estimates(graph: Graph, rounds: int = 100_000, lg_k: int = 10) -> DataFrame:
    """(id, descendants): estimates with a HyperLogLog sketch a vertex, merged along arcs until none changes, at most ``rounds`` times; linear space in the vertices."""
    arcs = save(graph.arcs().where("src <> dst").select("src", "dst").distinct(), "arcs")
    start = graph.vertices.groupBy("id").agg(F.hll_sketch_agg(F.col("id"), F.lit(lg_k)).alias("sketch"))

    def step(state: DataFrame) -> DataFrame:
        sent = arcs.join(state.select(F.col("id").alias("dst"), "sketch"), "dst").select(F.col("src").alias("id"), "sketch")
        merged = sent.unionByName(state.select("id", "sketch")).groupBy("id").agg(F.hll_union_agg("sketch", F.lit(False)).alias("sketch"))
        old = state.select("id", F.hll_sketch_estimate("sketch").alias("old"))
        return merged.join(old, "id").select("id", "sketch", (F.hll_sketch_estimate("sketch") != F.col("old")).alias("new"))

    out = fixpoint(start.withColumn("new", F.lit(True)), step, "new", rounds)
    return out.select("id", F.greatest(F.lit(0), F.hll_sketch_estimate("sketch") - 1).alias("descendants"))


def bridges(graph: Graph) -> DataFrame:
    """(src, dst) of the edges whose removal disconnects their ends.

    A spanning forest by breadth-first search names each vertex's parent; an
    edge outside the forest covers the tree path between its ends, counted by
    adding at the ends and taking away at their meeting point twice; tree edges
    that nothing covers are bridges. The meeting point is found by walking both
    ends up, level by level, in joins.
    """
    if graph.directed:
        raise ValueError("bridges are defined for undirected graphs")
    from graphloom.operators.paths import bfs

    comps = weak_components(graph)
    tree = save(bfs(graph, comps.select(F.col("component").alias("id")).distinct()), "tree")
    up = tree.select("id", "parent", "depth")
    edges = graph.edges.where("src <> dst").select("src", "dst")
    child = up.where("parent is not null").select(F.least("id", "parent").alias("src"), F.greatest("id", "parent").alias("dst"), F.col("id").alias("child"))
    outside = edges.join(child, ["src", "dst"], "left_anti")
    at = up.select(F.col("id").alias("a"), F.col("depth").alias("da")), up.select(F.col("id").alias("b"), F.col("depth").alias("db"))
    walk = outside.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(True).alias("new")).join(at[0], "a").join(at[1], "b").select("a", "b", "da", "db", "new", F.array().cast("array<long>").alias("passed"))
    walk = walk.select("a", "b", "da", "db", "new", F.lit(None).cast("long").alias("covered"))

    def step(state: DataFrame) -> DataFrame:
        live = state.where("new and a <> b")
        pa, pb = up.select(F.col("id").alias("a"), F.col("parent").alias("pa")), up.select(F.col("id").alias("b"), F.col("parent").alias("pb"))
        live = live.join(pa, "a").join(pb, "b")
        move_a, move_b = F.col("da") >= F.col("db"), F.col("db") >= F.col("da")
        moved = live.select(F.when(move_a, F.col("pa")).otherwise(F.col("a")).alias("a2"), F.when(move_b, F.col("pb")).otherwise(F.col("b")).alias("b2"), (F.col("da") - move_a.cast("int")).alias("da"), (F.col("db") - move_b.cast("int")).alias("db"), F.when(move_a, F.col("a")).alias("ca"), F.when(move_b, F.col("b")).alias("cb"))
        cover = moved.select(F.explode(F.array("ca", "cb")).alias("covered")).where("covered is not null").distinct()
        old = state.where("covered is not null").select("covered")
        rows = old.unionByName(cover).distinct().select(F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("int").alias("da"), F.lit(None).cast("int").alias("db"), F.lit(False).alias("new"), "covered")
        return rows.unionByName(moved.where("a2 <> b2").select(F.col("a2").alias("a"), F.col("b2").alias("b"), "da", "db", F.lit(True).alias("new"), F.lit(None).cast("long").alias("covered")).distinct())

    covered = fixpoint(walk, step, "new").where("covered is not null").select(F.col("covered").alias("child"))
    return child.join(covered, "child", "left_anti").select("src", "dst")


def biconnected_components(graph: Graph) -> DataFrame:
    """(src, dst, component): edges on a common cycle share a component, named by its smallest member of a search tree's lower ends.

    With a breadth-first forest, an edge outside it closes a cycle with the
    tree path between its ends; two edges are biconnected just if such cycles
    lead from one to the other. Both ends walk up, level by level in joins, and
    link the tree edges that they pass; what is linked is one component.
    """
    if graph.directed:
        raise ValueError("biconnected components are defined for undirected graphs")
    from graphloom.operators.paths import bfs

    tree = save(bfs(graph, weak_components(graph).select(F.col("component").alias("id")).distinct()), "tree")
    up = tree.select("id", "parent", "depth")
    edges = graph.edges.where("src <> dst").select("src", "dst")
    child = save(up.where("parent is not null").select(F.least("id", "parent").alias("src"), F.greatest("id", "parent").alias("dst"), F.col("id").alias("child")), "children")
    a, b = up.select(F.col("id").alias("a"), F.col("depth").alias("da")), up.select(F.col("id").alias("b"), F.col("depth").alias("db"))
    outside = save(edges.join(child, ["src", "dst"], "left_anti").select(F.col("src").alias("a"), F.col("dst").alias("b")).join(a, "a").join(b, "b"), "outside")
    none = F.lit(None).cast("long")
    walk, links = save(outside.select("a", "b", "da", "db", none.alias("la"), none.alias("lb")), "walk"), child.select(F.col("child").alias("x"), F.col("child").alias("y"))
    links = save(links, "links")
    while not walk.isEmpty():
        both = walk.join(up.select(F.col("id").alias("a"), F.col("parent").alias("pa")), "a").join(up.select(F.col("id").alias("b"), F.col("parent").alias("pb")), "b")
        move_a, move_b = F.col("da") >= F.col("db"), F.col("db") >= F.col("da")
        moved = both.select(
            F.when(move_a, F.col("pa")).otherwise(F.col("a")).alias("a"), F.when(move_b, F.col("pb")).otherwise(F.col("b")).alias("b"),
            (F.col("da") - move_a.cast("int")).alias("da"), (F.col("db") - move_b.cast("int")).alias("db"),
            F.when(move_a, F.col("a")).otherwise(F.col("la")).alias("la"), F.when(move_b, F.col("b")).otherwise(F.col("lb")).alias("lb"),
            F.when(move_a, F.col("la")).alias("oa"), F.when(move_b, F.col("lb")).alias("ob"),
        )
        moved = save(moved, "moved")
        passed = moved.select(F.col("oa").alias("x"), F.col("la").alias("y")).unionByName(moved.select(F.col("ob").alias("x"), F.col("lb").alias("y"))).unionByName(moved.where("a = b").select(F.col("la").alias("x"), F.col("lb").alias("y")))
        links = links.unionByName(save(passed.where("x is not null and y is not null").distinct(), "links"))
        walk = save(moved.where("a <> b").select("a", "b", "da", "db", "la", "lb").distinct(), "walk")
    comps = save(connected_components(links, "x", "y"), "comps")
    of_tree = child.join(comps, F.col("child") == F.col("id")).select("src", "dst", "component")
    lower = outside.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.when(F.col("da") >= F.col("db"), F.col("a")).otherwise(F.col("b")).alias("child"))
    return of_tree.unionByName(lower.join(comps, F.col("child") == F.col("id")).select("src", "dst", "component"))


def articulation_points(graph: Graph) -> DataFrame:
    """(id) of the vertices whose removal splits their component: those with edges of several biconnected components."""
    e = biconnected_components(graph)
    ends = e.select(F.col("src").alias("id"), "component").unionByName(e.select(F.col("dst").alias("id"), "component"))
    return ends.groupBy("id").agg(F.count_distinct("component").alias("n")).where("n > 1").select("id")
