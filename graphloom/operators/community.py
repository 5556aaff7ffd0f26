"""Communities and their measures."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from graphloom.graph import Graph
from graphloom.operators.transforms import quotient
from graphloom.plans import connected_components, save
from graphloom.plans.fixpoint import rounds


def _simple(graph: Graph) -> DataFrame:
    return graph.both_ways().where("src <> dst").select("src", "dst").distinct()


def _ordered(graph: Graph) -> DataFrame:
    """Each edge once, from the end of lower (degree, id) to the other, which bounds out-degrees by sqrt(2 m)."""
    arcs = _simple(graph)
    d = arcs.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    both = arcs.join(d, "src").join(d.select(F.col("src").alias("dst"), F.col("d").alias("e")), "dst")
    return both.where("d < e or (d = e and src < dst)").select("src", "dst")


def triangles(graph: Graph) -> DataFrame:
    """(a, b, c) in the order of degree; every triangle once."""
    e = save(_ordered(graph), "ordered")
    two = e.select(F.col("src").alias("a"), F.col("dst").alias("b")).join(e.select(F.col("src").alias("a"), F.col("dst").alias("c")), "a")
    return two.join(e.select(F.col("src").alias("b"), F.col("dst").alias("c")), ["b", "c"]).select("a", "b", "c")


def triangle_count(graph: Graph) -> DataFrame:
    return triangles(graph).agg(F.count(F.lit(1)).alias("n_triangles"))


def clustering(graph: Graph) -> DataFrame:
    """(id, triangles, degree, clustering); under two neighbours it is 0."""
    t = triangles(graph).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("triangles"))
    d = _simple(graph).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    all_ = graph.vertices.select("id").join(t, "id", "left").join(d, "id", "left").na.fill(0, ["triangles", "degree"])
    return all_.withColumn("clustering", F.when(F.col("degree") > 1, 2.0 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0))


def average_clustering(graph: Graph) -> DataFrame:
    return clustering(graph).agg(F.coalesce(F.avg("clustering"), F.lit(0.0)).alias("average_clustering"))


def transitivity(graph: Graph) -> DataFrame:
    c = clustering(graph).agg(F.sum("triangles").alias("t"), F.sum(F.col("degree") * (F.col("degree") - 1) / 2).alias("wedges"))
    return c.select(F.when(F.col("wedges") > 0, F.col("t") / F.col("wedges")).otherwise(0.0).alias("transitivity"))


def density(graph: Graph) -> DataFrame:
    """2 m / (n (n - 1)), whatever the kind."""
    n = graph.vertices.agg(F.count(F.lit(1)).alias("n")).join(graph.edges.agg(F.count(F.lit(1)).alias("m")))
    return n.select(F.when(F.col("n") > 1, 2.0 * F.col("m") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0).alias("density"))


def k_cliques(graph: Graph, k: int) -> DataFrame:
    """(members): all cliques of k vertices, each once, by joining one ordered edge at a time."""
    e = save(_ordered(graph), "ordered")
    found = e.select(F.array("src", "dst").alias("members")) if k > 1 else graph.vertices.select(F.array("id").alias("members"))
    for size in range(2, k):
        grown = found.join(e.select(F.col("src").alias("first"), F.col("dst").alias("next")), F.col("members")[0] == F.col("first"))
        for i in range(1, size):
            grown = grown.join(e.select(F.col("src").alias(f"s{i}"), F.col("dst").alias(f"d{i}")), (F.col("members")[i] == F.col(f"s{i}")) & (F.col("next") == F.col(f"d{i}")), "left_semi")
        found = grown.select(F.concat("members", F.array("next")).alias("members"))
    return found.select(F.array_sort("members").alias("members"))


def _expanded(near: list[int], p: int, x: int) -> Iterator[int]:
    """Bron and Kerbosch with a pivot over bit sets: the sets of ``p`` that no vertex of ``p`` or ``x`` extends; near: neighbours of each vertex."""
    stack = [(0, p, x)]
    while stack:
        r, p, x = stack.pop()
        if not p:
            if not x:
                yield r
            continue
        pivot, most = 0, -1
        rest = p | x
        while rest:
            v = (rest & -rest).bit_length() - 1
            rest &= rest - 1
            if (n := (near[v] & p).bit_count()) > most:
                pivot, most = v, n
        branch = p & ~near[pivot]
        while branch:
            v = (branch & -branch).bit_length() - 1
            bit = 1 << v
            stack.append((r | bit, p & near[v], x & near[v]))
            p, x, branch = p & ~bit, x | bit, branch & ~bit


def maximal_cliques(graph: Graph) -> DataFrame:
    """(members): all cliques that no vertex extends, from single vertices on.

    Every clique is found at its first member in the order of degrees, among
    the neighbours that come later, of which there are at most sqrt(2 m). A
    task holds these of one vertex, the edges between them and those from its
    earlier neighbours, all of which come from triangles made once; a clique
    that an earlier neighbour extends belongs to that one. The answer can be
    exponential, the work follows it.
    """
    e = save(_ordered(graph), "ordered")
    tri = save(triangles(graph), "triangles")
    id_type = e.schema["src"].dataType.simpleString()
    none = F.lit(None).cast(id_type)
    rows = e.select(F.col("src").alias("v"), F.col("dst").alias("a"), none.alias("b"), F.lit(False).alias("before"))
    rows = rows.unionByName(tri.select(F.col("a").alias("v"), F.col("b").alias("a"), F.col("c").alias("b"), F.lit(False).alias("before")))
    rows = rows.unionByName(tri.select(F.col("b").alias("v"), F.col("c").alias("a"), F.col("a").alias("b"), F.lit(True).alias("before")))

    def cliques(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = [r for batch in batches for r in zip(*(batch[c].to_pylist() for c in ("a", "b", "before")), strict=True)]
        later = sorted({a for a, _, _ in links})
        names = later + sorted({b for _, b, before in links if before})
        at = {v: i for i, v in enumerate(names)}
        near = [0] * len(names)
        for a, b, _ in links:
            if b is not None:
                near[at[a]] |= 1 << at[b]
                near[at[b]] |= 1 << at[a]
        out, whole = [], (1 << len(later)) - 1
        for found in _expanded(near, whole, (1 << len(names)) - 1 - whole):
            out.append(sorted([key[0].as_py(), *(later[i] for i in range(len(later)) if found >> i & 1)]))
            if len(out) == 10_000:
                yield pa.record_batch([pa.array(out, type_)], ["members"])
                out = []
        if out:
            yield pa.record_batch([pa.array(out, type_)], ["members"])

    type_ = pa.list_(to_arrow_type(e.schema["src"].dataType))
    linked = rows.groupBy("v").applyInArrow(cliques, f"members array<{id_type}>")
    ends = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id")))
    return save(linked.unionByName(graph.vertices.join(ends, "id", "left_anti").select(F.array("id").alias("members"))), "cliques")


def maximum_clique(graph: Graph) -> DataFrame:
    """One row (members): a largest clique, of several the first in order; no row for an empty graph."""
    return maximal_cliques(graph).orderBy(F.desc(F.size("members")), "members").limit(1)


def clique_percolation(graph: Graph, k: int = 3) -> DataFrame:
    """(id, community): unions of k-cliques that share k - 1 vertices; a vertex may be in several."""
    cliques = save(k_cliques(graph, k).withColumn("clique", F.xxhash64("members")), "cliques")
    faces = cliques.select("clique", F.explode(F.transform("members", lambda m: F.array_remove(F.col("members"), m))).alias("face"))
    hub = faces.groupBy("face").agg(F.min("clique").alias("hub"))
    comps = connected_components(faces.join(hub, "face").select(F.col("clique").alias("src"), F.col("hub").alias("dst")))
    found = cliques.join(comps, F.col("clique") == F.col("id")).select(F.explode("members").alias("id"), "component").distinct()
    name = found.groupBy("component").agg(F.min("id").alias("community"), F.xxhash64(F.sort_array(F.collect_set("id"))).alias("h"))
    return found.join(name, "component").select("id", "community", F.col("component").alias("key"))


def modularity(graph: Graph, communities: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row (modularity) of (id, community)."""
    a, b = communities.select(F.col("id").alias("src"), F.col("community").alias("ca")), communities.select(F.col("id").alias("dst"), F.col("community").alias("cb"))
    arcs = graph.arcs() if graph.directed else graph.edges.select("src", "dst", F.coalesce("weight", F.lit(1)).alias("weight")).unionByName(graph.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.coalesce("weight", F.lit(1)).alias("weight")))
    e = arcs.join(a, "src").join(b, "dst")
    total = e.agg(F.sum("weight").cast("double").alias("m"))
    out = e.groupBy(F.col("ca").alias("c")).agg(F.sum("weight").alias("o"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0)).alias("inside"))
    into = e.groupBy(F.col("cb").alias("c")).agg(F.sum("weight").alias("i"))
    each = out.join(into, "c", "full").na.fill(0, ["o", "inside", "i"]).join(F.broadcast(total))
    return each.agg(F.coalesce(F.sum(F.col("inside") / F.col("m") - resolution * F.col("o") * F.col("i") / (F.col("m") * F.col("m"))), F.lit(0.0)).alias("modularity"))


def label_propagation(graph: Graph, max_iter: int = 20) -> DataFrame:
    """(id, community): every vertex takes the heaviest label around it, ties to the smallest; synchronous rounds.

    A vertex's own label counts with half the weight of a unit edge, which
    keeps two-coloured parts from swapping labels for ever.
    """
    arcs = save(graph.both_ways().where("src <> dst").select("src", "dst", F.col("weight").cast("double").alias("weight")), "arcs")
    start = graph.vertices.select("id", F.col("id").alias("community"), F.lit(True).alias("new"))

    def step(state: DataFrame) -> DataFrame:
        sent = arcs.join(state, F.col("src") == F.col("id")).select(F.col("dst").alias("v"), "community", "weight")
        votes = sent.unionByName(state.select(F.col("id").alias("v"), "community", F.lit(0.5).alias("weight"))).groupBy("v", "community").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("v").agg(F.max_by("community", F.struct("w", -F.col("community"))).alias("best"))
        return state.join(best, F.col("id") == F.col("v")).select("id", F.col("best").alias("community"), (F.col("best") != F.col("community")).alias("new"))

    return rounds(start, step, max_iter, lambda old, new: new.where("new").isEmpty()).select("id", "community")


def _folded(graph: Graph) -> DataFrame:
    """(src, dst, weight) without regard to direction, one row a pair."""
    ends = [F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")]
    return graph.edges.select(*ends, F.coalesce("weight", F.lit(1)).alias("weight")).groupBy("src", "dst").agg(F.sum("weight").cast("double").alias("weight"))


def _level(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The arcs (src, dst, weight) of a level and the weighted degrees (v, k); a loop counts twice."""
    apart = edges.where("src <> dst")
    arcs = save(apart.unionByName(apart.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")), "arcs")
    loops = edges.where("src = dst").select(F.col("src").alias("v"), (2 * F.col("weight")).alias("w"))
    return arcs, save(arcs.select(F.col("src").alias("v"), F.col("weight").alias("w")).unionByName(loops).groupBy("v").agg(F.sum("w").alias("k")), "k")


def _moved(arcs: DataFrame, state: DataFrame, m2: float, passes: int, resolution: float) -> tuple[DataFrame, bool]:
    """(v, c, k) after at most ``passes`` of moves to the best community along ``arcs``, and whether any vertex moved."""
    any_moved = False
    for turn in range(passes):
        total = state.groupBy("c").agg(F.sum("k").alias("total"))
        to = arcs.join(state.select(F.col("v").alias("dst"), F.col("c").alias("to")), "dst").groupBy(F.col("src").alias("v"), "to").agg(F.sum("weight").alias("w"))
        to = to.unionByName(state.select("v", F.col("c").alias("to"), F.lit(0.0).alias("w"))).groupBy("v", "to").agg(F.sum("w").alias("w"))
        seen = to.join(state, "v").join(total.withColumnRenamed("c", "to"), "to")
        others = F.col("total") - F.when(F.col("to") == F.col("c"), F.col("k")).otherwise(0.0)
        gain = F.round(F.col("w") - resolution * F.col("k") * others / m2, 9)
        best = seen.groupBy("v").agg(F.max_by("to", F.struct(gain, (F.col("to") == F.col("c")).cast("int"), -F.col("to"))).alias("best"))
        mine = F.pmod(F.xxhash64("v"), F.lit(2)) == turn % 2
        new = save(state.join(best, "v").select("v", F.when(mine, F.col("best")).otherwise(F.col("c")).alias("c"), "k", (mine & (F.col("best") != F.col("c"))).alias("moved")), "state")
        moved = not new.where("moved").isEmpty()
        state, any_moved = new.drop("moved"), any_moved or moved
        if not moved and turn % 2:
            break
    return state, any_moved


def _merged(edges: DataFrame, of: DataFrame) -> DataFrame:
    """Edges between the blocks of (v, c)."""
    a, b = of.select(F.col("v").alias("src"), F.col("c").alias("a")), of.select(F.col("v").alias("dst"), F.col("c").alias("b"))
    return save(edges.join(a, "src").join(b, "dst").groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum("weight").alias("weight")), "level")


def _renamed(where: DataFrame, of: DataFrame) -> DataFrame:
    """(id, community) with each community replaced by what (v, c) says; others stay."""
    return save(where.join(of.select(F.col("v").alias("community"), "c"), "community", "left").select("id", F.coalesce("c", "community").alias("community")), "where")


def _inside(arcs: DataFrame, of: DataFrame) -> DataFrame:
    """The arcs whose ends share a block of (v, c)."""
    a, b = of.select(F.col("v").alias("src"), F.col("c").alias("a")), of.select(F.col("v").alias("dst"), F.col("c").alias("b"))
    return save(arcs.join(a, "src").join(b, "dst").where("a = b").drop("a", "b"), "inside")


def _connected(arcs: DataFrame, of: DataFrame) -> DataFrame:
    """(v, c): the blocks of (v, c) split into their connected parts, each named after its smallest vertex."""
    parts = connected_components(_inside(arcs, of))
    return save(of.join(parts, F.col("v") == F.col("id"), "left").select("v", F.coalesce("component", "v").alias("c")), "parts")


def louvain(graph: Graph, levels: int = 10, passes: int = 8, resolution: float = 1.0) -> DataFrame:
    """(id, community) by greedy modularity, in parallel.

    In a pass every vertex looks for the neighbouring community of the largest
    gain; only vertices of one hashed half move, the halves alternating, so
    that neighbours do not chase each other. A level ends when nothing moves;
    communities then become the vertices of the next level.
    """
    edges = save(_folded(graph), "level")
    where = save(graph.vertices.select("id", F.col("id").alias("community")), "where")
    m2 = 2.0 * (edges.agg(F.sum("weight")).first()[0] or 0.0)
    if not m2:
        return where
    for _ in range(levels):
        arcs, k = _level(edges)
        state, any_moved = _moved(arcs, save(k.select("v", F.col("v").alias("c"), "k"), "state"), m2, passes, resolution)
        if not any_moved:
            break
        where, edges = _renamed(where, state), _merged(edges, state)
    name = where.groupBy("community").agg(F.min("id").alias("least"))
    return where.join(name, "community").select("id", F.col("least").alias("community"))


def leiden(graph: Graph, levels: int = 10, passes: int = 8, resolution: float = 1.0) -> DataFrame:
    """(id, community) by greedy modularity with refinement; every community is connected.

    After the moves of a level, as in ``louvain``, the vertices start alone
    once more and join up within their communities only; the connected parts
    of that become the vertices of the next level, which starts from the
    communities found. Ends when no part holds two vertices.
    """
    edges = save(_folded(graph), "level")
    where = save(graph.vertices.select("id", F.col("id").alias("community")), "where")
    m2 = 2.0 * (edges.agg(F.sum("weight")).first()[0] or 0.0)
    if not m2:
        return where
    whole, k = _level(edges)
    arcs, state = whole, save(k.select("v", F.col("v").alias("c"), "k"), "state")
    for _ in range(levels):
        state, _any = _moved(arcs, state, m2, passes, resolution)
        alone = save(k.select("v", F.col("v").alias("c"), "k"), "state")
        inside = _inside(arcs, state)
        refined = _connected(inside, _moved(inside, alone, m2, passes, resolution)[0])
        if refined.where("v <> c").isEmpty():
            break
        kept = state.select("v", F.col("c").alias("of")).join(refined, "v").groupBy(F.col("c").alias("v")).agg(F.min("of").alias("c"))
        where, edges = _renamed(where, refined), _merged(edges, refined)
        arcs, k = _level(edges)
        state = save(kept.join(k, "v"), "state")
    found = _renamed(where, state)
    return _connected(whole, found.select(F.col("id").alias("v"), F.col("community").alias("c"))).select(F.col("v").alias("id"), F.col("c").alias("community"))


def community_sizes(communities: DataFrame) -> DataFrame:
    return communities.groupBy("community").agg(F.count(F.lit(1)).alias("n_nodes"))


def community_densities(graph: Graph, communities: DataFrame) -> DataFrame:
    """(community, n_nodes, n_edges, density) of the induced subgraphs."""
    a, b = communities.select(F.col("id").alias("src"), F.col("community").alias("ca")), communities.select(F.col("id").alias("dst"), F.col("community").alias("cb"))
    inside = graph.edges.join(a, "src").join(b, "dst").where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.count(F.lit(1)).alias("n_edges"))
    n = community_sizes(communities).join(inside, "community", "left").na.fill(0, ["n_edges"])
    return n.withColumn("density", F.when(F.col("n_nodes") > 1, 2.0 * F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1))).otherwise(0.0))


def nmi(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (nmi): 2 I / (H + H) of two assignments (id, community); 1 where both have one community."""
    both = a.select("id", F.col("community").alias("x")).join(b.select("id", F.col("community").alias("y")), "id")
    n = both.agg(F.count(F.lit(1)).cast("double").alias("n"))
    xy = both.groupBy("x", "y").agg(F.count(F.lit(1)).alias("c"))
    x, y = both.groupBy("x").agg(F.count(F.lit(1)).alias("cx")), both.groupBy("y").agg(F.count(F.lit(1)).alias("cy"))
    n = F.broadcast(n)
    mutual = xy.join(x, "x").join(y, "y").join(n).agg(F.sum(F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (F.col("cx") * F.col("cy")))).alias("i"))
    h = lambda t, c, o: t.join(n).agg(F.sum(-F.col(c) / F.col("n") * F.log(F.col(c) / F.col("n"))).alias(o))
    all_ = mutual.join(h(x, "cx", "hx")).join(h(y, "cy", "hy"))
    return all_.select(F.when(F.col("hx") + F.col("hy") > 0, 2 * F.col("i") / (F.col("hx") + F.col("hy"))).otherwise(1.0).alias("nmi"))


def community_graph(graph: Graph, communities: DataFrame) -> Graph:
    return quotient(graph, communities.select("id", F.col("community").alias("block")))
