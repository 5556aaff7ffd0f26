"""Writers: a graph becomes ordered lines, which Spark writes as text.

Each function returns (line) in the order of the format; ``write_text`` writes
any of them. Lines are made and sorted on executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators.transforms import ranked_ids
from graphloom.plans import save, ship
from graphloom.sources.bit_lines import graph6_line, sparse6_line


def _ordered(*parts: tuple[DataFrame, Column, Column]) -> DataFrame:
    """Lines of the parts one after the other, each by its own order."""
    out = None
    for i, (df, order, line) in enumerate(parts):
        one = df.select(F.lit(i).alias("part"), order.cast("string").alias("o"), line.alias("line"))
        out = one if out is None else out.unionByName(one)
    return out.orderBy("part", F.length("o"), "o").select("line")


def _one(graph: Graph, text: str | Column) -> tuple[DataFrame, Column, Column]:
    return graph.spark.range(1), F.lit("0"), F.lit(text) if isinstance(text, str) else text


def _ends() -> Column:
    return F.concat_ws(" ", F.lpad(F.col("src").cast("string"), 20, "0"), F.lpad(F.col("dst").cast("string"), 20, "0"))


def write_text(lines: DataFrame, path: str) -> None:
    lines.write.text(path)


def edge_list(graph: Graph) -> DataFrame:
    return _ordered((graph.edges, _ends(), F.concat_ws(" ", "src", "dst", "weight")))


def adjacency_list(graph: Graph, weighted: bool = False) -> DataFrame:
    to = F.concat_ws(",", "dst", "weight") if weighted else F.col("dst").cast("string")
    out = graph.arcs().groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list(F.struct("dst", to.alias("t")))).alias("x"))
    both = graph.vertices.select("id").join(out, "id", "left")
    line = F.concat(F.col("id").cast("string"), F.lit(":"), F.coalesce(F.concat(F.lit(" "), F.array_join(F.transform("x", lambda e: e["t"]), " ")), F.lit("")))
    return _ordered((both, F.lpad(F.col("id").cast("string"), 20, "0"), line))


def tgf(graph: Graph, label: str | None = None) -> DataFrame:
    node = F.concat_ws(" ", "id", F.col(label) if label else F.lit(None))
    return _ordered((graph.vertices, F.lpad(F.col("id").cast("string"), 20, "0"), node), _one(graph, "#"), (graph.edges, _ends(), F.concat_ws(" ", "src", "dst", "weight")))


def pajek(graph: Graph, label: str | None = None) -> DataFrame:
    n = graph.vertices.agg(F.concat(F.lit("*Vertices "), F.count(F.lit(1))).alias("line"))
    name = F.concat(F.lit('"'), F.coalesce(F.col(label) if label else F.col("id").cast("string"), F.lit("")), F.lit('"'))
    return _ordered((n, F.lit("0"), F.col("line")), (graph.vertices, F.lpad(F.col("id").cast("string"), 20, "0"), F.concat_ws(" ", "id", name)), _one(graph, "*Arcs" if graph.directed else "*Edges"), (graph.edges, _ends(), F.concat_ws(" ", "src", "dst", "weight")))


def matrix_market(graph: Graph) -> DataFrame:
    """Coordinate format, whose indices start at 1: vertices are numbered in the order of ids."""
    _, edges, n = _numbered(graph)
    edges = edges.select((F.col("src") + 1).alias("src"), (F.col("dst") + 1).alias("dst"), "weight")
    size = edges.agg(F.concat_ws(" ", F.lit(n), F.lit(n), F.count(F.lit(1))).alias("line"))
    kind = "general" if graph.directed else "symmetric"
    a, b = ("src", "dst") if graph.directed else ("dst", "src")  # symmetric files hold the lower triangle
    line = F.concat_ws(" ", a, b, F.coalesce("weight", F.lit(1)))
    return _ordered(_one(graph, f"%%MatrixMarket matrix coordinate real {kind}"), (size, F.lit("0"), F.col("line")), (edges, _ends(), line))


def gdf(graph: Graph, label: str | None = None) -> DataFrame:
    node = F.concat_ws(",", "id", F.coalesce(F.col(label) if label else F.col("id").cast("string"), F.lit("")))
    edge = F.concat_ws(",", "src", "dst", F.lit(str(graph.directed).lower()), F.coalesce(F.col("weight").cast("string"), F.lit("")))
    return _ordered(_one(graph, "nodedef>name VARCHAR,label VARCHAR"), (graph.vertices, F.lpad(F.col("id").cast("string"), 20, "0"), node), _one(graph, "edgedef>node1 VARCHAR,node2 VARCHAR,directed BOOLEAN,weight DOUBLE"), (graph.edges, _ends(), edge))


def _xml(c: str) -> Column:
    out = F.coalesce(F.col(c).cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def graphml(graph: Graph, label: str | None = None) -> DataFrame:
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n<key id="label" for="node" attr.name="label" attr.type="string"/>\n<key id="weight" for="edge" attr.name="weight" attr.type="string"/>\n' + f'<graph id="G" edgedefault="{"directed" if graph.directed else "undirected"}">'
    data = F.concat(F.lit('<data key="label">'), _xml(label), F.lit("</data>")) if label else F.lit("")
    node = F.concat(F.lit('<node id="'), _xml("id"), F.lit('">'), data, F.lit("</node>"))
    edge = F.concat(F.lit('<edge source="'), _xml("src"), F.lit('" target="'), _xml("dst"), F.lit('"><data key="weight">'), _xml("weight"), F.lit("</data></edge>"))
    return _ordered(_one(graph, head), (graph.vertices, F.lpad(F.col("id").cast("string"), 20, "0"), node), (graph.edges, _ends(), edge), _one(graph, "</graph>\n</graphml>"))


def _quoted(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.lit('"'), F.replace(c.cast("string"), F.lit('"'), F.lit('\\"')), F.lit('"'))


def dot(graph: Graph, label: str | None = None, highlight: DataFrame | None = None) -> DataFrame:
    """DOT text; edges of ``highlight`` (src, dst) are drawn red."""
    arrow = " -> " if graph.directed else " -- "
    edges = graph.edges
    edges = edges.join(highlight.select("src", "dst", F.lit(', color="red", penwidth=2').alias("mark")), ["src", "dst"], "left") if highlight is not None else edges.withColumn("mark", F.lit(None).cast("string"))
    node = F.concat(F.lit("  "), _quoted("id"), F.lit(" [label="), _quoted(F.coalesce(F.col(label), F.col("id").cast("string")) if label else F.col("id")), F.lit("];"))
    edge = F.concat(F.lit("  "), _quoted("src"), F.lit(arrow), _quoted("dst"), F.lit(" [label="), _quoted(F.coalesce(F.col("weight").cast("string"), F.lit(""))), F.coalesce("mark", F.lit("")), F.lit("];"))
    return _ordered(_one(graph, "digraph G {" if graph.directed else "graph G {"), (graph.vertices, F.lpad(F.col("id").cast("string"), 20, "0"), node), (edges, _ends(), edge), _one(graph, "}"))


def mermaid(graph: Graph, label: str | None = None) -> DataFrame:
    node = F.concat(F.lit("  n"), F.col("id").cast("string"), F.lit("["), _quoted(F.coalesce(F.col(label), F.col("id").cast("string")) if label else F.col("id")), F.lit("]"))
    edge = F.concat(F.lit("  n"), F.col("src").cast("string"), F.lit(" -->|" if graph.directed else " ---|"), F.coalesce(F.col("weight").cast("string"), F.lit("")), F.lit("| n"), F.col("dst").cast("string"))
    return _ordered(_one(graph, "graph TD"), (graph.vertices, F.lpad(F.col("id").cast("string"), 20, "0"), node), (graph.edges, _ends(), edge))


def json_rows(graph: Graph) -> DataFrame:
    """JSON lines {"type": "node" | "edge", ...}."""
    return _ordered((graph.vertices, F.lpad(F.col("id").cast("string"), 20, "0"), F.to_json(F.struct(F.lit("node").alias("type"), "*"))), (graph.edges, _ends(), F.to_json(F.struct(F.lit("edge").alias("type"), "*"))))


def _numbered(graph: Graph) -> tuple[DataFrame, DataFrame, int]:
    """Vertices with their place by id (from 0) as ``new``, the edges between places, and how many vertices there are."""
    ids = save(ranked_ids(graph).select("id", "new"), "places")
    a, b = ids.select(F.col("id").alias("src"), F.col("new").alias("s")), ids.select(F.col("id").alias("dst"), F.col("new").alias("d"))
    edges = graph.edges.join(a, "src").join(b, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"), "weight")
    return ids, edges, ids.count()


def adjacency_matrix(graph: Graph) -> DataFrame:
    """A line of weights for each vertex in the order of ids; 0 is no edge.

    Rows are sorted by the arcs that they hold; the zeros between these come
    after, so the sort moves no more than the graph.
    """
    ids, edges, n = _numbered(graph)
    arcs = Graph(ids, edges, graph.directed).arcs()
    held = arcs.groupBy(F.col("src").alias("new")).agg(F.sort_array(F.collect_list(F.struct("dst", F.col("weight").cast("double").alias("w")))).alias("to"))
    to = F.coalesce("to", F.array().cast("array<struct<dst:bigint,w:double>>"))
    zeros = lambda k: F.repeat(F.lit("0.0 "), k.cast("int"))
    before = lambda i: F.when(i == 0, F.lit(-1).cast("long")).otherwise(F.get(to, i - 1)["dst"])
    cells = F.array_join(F.transform(to, lambda x, i: F.concat(zeros(x["dst"] - before(i) - 1), x["w"].cast("string"), F.lit(" "))), "")
    last = F.coalesce(F.try_element_at(to, F.lit(-1))["dst"], F.lit(-1).cast("long"))
    line = F.rtrim(F.concat(cells, zeros(F.lit(n - 1) - last)))
    return ids.join(held, "new", "left").orderBy("new").select(line.alias("line"))


def leda(graph: Graph, label: str | None = None) -> DataFrame:
    """LEDA.GRAPH; vertices are numbered from 1 in the order of ids, which are their labels unless a column is named."""
    ids, edges, n = _numbered(graph)
    boxed = lambda c: F.concat(F.lit("|{"), F.coalesce(c.cast("string"), F.lit("")), F.lit("}|"))
    named = ids.join(graph.vertices, "id")
    edges = edges.select((F.col("src") + 1).alias("src"), (F.col("dst") + 1).alias("dst"), "weight")
    size = edges.agg(F.count(F.lit(1)).cast("string").alias("m"))
    head = f"LEDA.GRAPH\nstring\nstring\n{-1 if graph.directed else -2}\n{n}"
    line = F.concat_ws(" ", "src", "dst", F.lit("0"), boxed(F.col("weight")))
    return _ordered(_one(graph, head), (named, F.lpad(F.col("new").cast("string"), 20, "0"), boxed(F.col(label or "id"))), (size, F.lit("0"), F.col("m")), (edges, _ends(), line))


def gexf(graph: Graph, label: str | None = None) -> DataFrame:
    kind = "directed" if graph.directed else "undirected"
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://gexf.net/1.3" version="1.3">\n<graph defaultedgetype="{kind}">\n<nodes>'
    node = F.concat(F.lit('<node id="'), _xml("id"), F.lit('" label="'), _xml(label or "id"), F.lit('"/>'))
    weight = F.coalesce(F.concat(F.lit(' weight="'), F.col("weight").cast("string"), F.lit('"')), F.lit(""))
    edge = F.concat(F.lit('<edge id="'), _xml("src"), F.lit("-"), _xml("dst"), F.lit('" source="'), _xml("src"), F.lit('" target="'), _xml("dst"), F.lit('"'), weight, F.lit("/>"))
    by_id = F.lpad(F.col("id").cast("string"), 20, "0")
    return _ordered(_one(graph, head), (graph.vertices, by_id, node), _one(graph, "</nodes>\n<edges>"), (graph.edges, _ends(), edge), _one(graph, "</edges>\n</graph>\n</gexf>"))


def _size(n: int) -> str:
    """The number of vertices at the start of a graph6 or sparse6 line."""
    marks, digits = ("", 1) if n < 63 else ("~", 3) if n < 258048 else ("~~", 6)
    return marks + "".join(chr(63 + (n >> 6 * i & 63)) for i in reversed(range(digits)))


def _simple_edges(graph: Graph) -> tuple[DataFrame, int]:
    if graph.directed:
        raise ValueError("the format holds undirected graphs")
    _, edges, n = _numbered(graph)
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").distinct(), n


def _bit_line(graph: Graph, head: str, of: Callable) -> DataFrame:
    edges, n = _simple_edges(graph)
    ship(graph.spark)
    none = graph.spark.range(1).select(F.lit(-1).cast("long").alias("src"), F.lit(-1).cast("long").alias("dst"))  # a graph without edges has a line, too
    rows = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).unionByName(none)
    return rows.coalesce(1).mapInArrow(of(n, head + _size(n)), "line string")


def graph6(graph: Graph) -> DataFrame:
    """One line; vertices are numbered in the order of ids, loops are left out. A line is a row, which bounds the graph."""
    return _bit_line(graph, "", graph6_line)


def sparse6(graph: Graph) -> DataFrame:
    """One line; vertices are numbered in the order of ids, loops are left out. A line is a row, which bounds the graph."""
    return _bit_line(graph, ":", sparse6_line)
