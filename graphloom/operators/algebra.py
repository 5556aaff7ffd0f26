"""Set operations and products of graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph, canonical
from graphloom.operators.transforms import ranked_ids, subgraph


def _same_kind(a: Graph, b: Graph) -> None:
    if a.directed != b.directed:
        raise ValueError("one graph is directed, the other is not")


def union(a: Graph, b: Graph) -> Graph:
    """All vertices and edges; the second graph's data and weights win."""
    _same_kind(a, b)
    vertices = a.vertices.join(b.vertices, "id", "left_anti").unionByName(b.vertices, allowMissingColumns=True)
    edges = a.edges.join(b.edges, ["src", "dst"], "left_anti").select("src", "dst", "weight").unionByName(b.edges)
    return Graph(vertices, edges, a.directed)


def intersection(a: Graph, b: Graph) -> Graph:
    """Common vertices and edges, with the first graph's weights."""
    _same_kind(a, b)
    return Graph(a.vertices.join(b.vertices, "id", "left_semi"), a.edges.join(b.edges, ["src", "dst"], "left_semi").select("src", "dst", "weight"), a.directed)


def difference(a: Graph, b: Graph) -> Graph:
    """Vertices of the first graph that are not in the second, and their edges."""
    _same_kind(a, b)
    kept = subgraph(a, a.vertices.join(b.vertices, "id", "left_anti"))
    return kept.with_edges(kept.edges.join(b.edges, ["src", "dst"], "left_anti").select("src", "dst", "weight"))


def edge_difference(a: Graph, b: Graph) -> Graph:
    """All vertices of the first graph, and its edges that are not in the second."""
    _same_kind(a, b)
    return a.with_edges(a.edges.join(b.edges, ["src", "dst"], "left_anti").select("src", "dst", "weight"))


def symmetric_difference(a: Graph, b: Graph) -> Graph:
    """Vertices of one graph alone and the edges among them."""
    return union(difference(a, b), difference(b, a))


def disjoint_union(a: Graph, b: Graph) -> Graph:
    """Both graphs side by side; ids become structs (side, id)."""
    _same_kind(a, b)
    tag = lambda side, c: F.struct(F.lit(side).alias("side"), F.col(c).alias("id")).alias(c)
    of = lambda g, side: (g.vertices.withColumn("id", tag(side, "id")), g.edges.select(tag(side, "src"), tag(side, "dst"), "weight"))
    (va, ea), (vb, eb) = of(a, 0), of(b, 1)
    return Graph(va.unionByName(vb, allowMissingColumns=True), ea.unionByName(eb), a.directed)


def _products(a: Graph, b: Graph) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Ranks of the vertices, and arcs between ranks; the id of a pair is rank in a * |b| + rank in b."""
    ra, rb = ranked_ids(a), ranked_ids(b)
    n = b.vertices.agg(F.count(F.lit(1)).alias("n"))

    def ranked(g: Graph, r: DataFrame) -> DataFrame:
        s, d = r.select(F.col("id").alias("src"), F.col("new").alias("s")), r.select(F.col("id").alias("dst"), F.col("new").alias("d"))
        return g.arcs().join(s, "src").join(d, "dst").select("s", "d")

    return ra, rb, n, ranked(a, ra), ranked(b, rb)


def _built(a: Graph, ra: DataFrame, rb: DataFrame, n: DataFrame, pairs: DataFrame) -> Graph:
    """pairs: (s, d) arcs of the first, (p, q) of the second graph; the one-row n is of proven size."""
    n = F.broadcast(n)
    vertices = ra.select(F.col("new").alias("i")).join(rb.select(F.col("new").alias("j"))).join(n).select((F.col("i") * F.col("n") + F.col("j")).alias("id"))
    edges = pairs.join(n).select((F.col("s") * F.col("n") + F.col("p")).alias("src"), (F.col("d") * F.col("n") + F.col("q")).alias("dst"), F.lit(1).cast("long").alias("weight"))
    edges = edges if a.directed else canonical(edges)
    return Graph(vertices, edges.distinct(), a.directed)


def cartesian_product(a: Graph, b: Graph) -> Graph:
    """(u, v) to (u', v) along the first graph and to (u, v') along the second."""
    ra, rb, n, ea, eb = _products(a, b)
    along_a = ea.join(rb.select(F.col("new").alias("p"), F.col("new").alias("q")))
    along_b = eb.withColumnsRenamed({"s": "p", "d": "q"}).join(ra.select(F.col("new").alias("s"), F.col("new").alias("d")))
    return _built(a, ra, rb, n, along_a.select("s", "d", "p", "q").unionByName(along_b.select("s", "d", "p", "q")))


def tensor_product(a: Graph, b: Graph) -> Graph:
    ra, rb, n, ea, eb = _products(a, b)
    return _built(a, ra, rb, n, ea.join(eb.withColumnsRenamed({"s": "p", "d": "q"})))


def strong_product(a: Graph, b: Graph) -> Graph:
    one, other = cartesian_product(a, b), tensor_product(a, b)
    return one.with_edges(one.edges.unionByName(other.edges).distinct())


def lexicographic_product(a: Graph, b: Graph) -> Graph:
    """(u, v) to (u', any) along the first graph, and copies of the second graph."""
    ra, rb, n, ea, eb = _products(a, b)
    across = ea.join(rb.select(F.col("new").alias("p"))).join(rb.select(F.col("new").alias("q")))
    inside = eb.withColumnsRenamed({"s": "p", "d": "q"}).join(ra.select(F.col("new").alias("s"), F.col("new").alias("d")))
    return _built(a, ra, rb, n, across.select("s", "d", "p", "q").unionByName(inside.select("s", "d", "p", "q")))


def line_graph(graph: Graph) -> Graph:
    """A vertex (struct src, dst) for each edge; edges that follow each other (directed) or share an end are linked."""
    e = graph.edges.select(F.struct("src", "dst").alias("id"), "src", "dst")
    if graph.directed:
        a, b = e.select(F.col("id").alias("x"), F.col("dst").alias("m")), e.select(F.col("id").alias("y"), F.col("src").alias("m"))
        pairs = a.join(b, "m").where("x <> y")
    else:
        ends = e.select("id", F.col("src").alias("m")).unionByName(e.select("id", F.col("dst").alias("m"))).distinct()
        pairs = ends.withColumnRenamed("id", "x").join(ends.withColumnRenamed("id", "y"), "m").where("x < y")
    return Graph(e.select("id"), pairs.select(F.col("x").alias("src"), F.col("y").alias("dst"), F.lit(1).cast("long").alias("weight")).distinct(), graph.directed)


def power(graph: Graph, k: int) -> Graph:
    """Vertices at a distance of at most k are linked; existing edges keep their weight."""
    arcs = graph.arcs().select("src", "dst").where("src <> dst").distinct()
    reach = arcs
    for _ in range(k - 1):
        step = reach.select("src", F.col("dst").alias("m")).join(arcs.select(F.col("src").alias("m"), "dst"), "m").where("src <> dst").select("src", "dst")
        reach = reach.unionByName(step).distinct()
    if not graph.directed:
        reach = reach.where("src < dst")
    new = reach.join(graph.edges, ["src", "dst"], "left_anti").withColumn("weight", F.lit(1).cast(graph.edges.schema["weight"].dataType))
    return graph.with_edges(graph.edges.unionByName(new))


def is_subgraph(part: Graph, whole: Graph) -> DataFrame:
    """One row (is_subgraph): all vertices and edges of ``part`` are in ``whole``."""
    v = part.vertices.join(whole.vertices, "id", "left_anti").agg(F.count(F.lit(1)).alias("v"))
    e = part.edges.join(whole.edges, ["src", "dst"], "left_anti").agg(F.count(F.lit(1)).alias("e"))
    return v.join(e).select(((F.col("v") == 0) & (F.col("e") == 0)).alias("is_subgraph"))
