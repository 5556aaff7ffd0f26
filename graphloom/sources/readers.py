"""Readers of graph text formats; each is a plan over lines, and bad lines come back as warnings where the format asks for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import Graph, canonical, from_edges
from graphloom.plans import ship
from graphloom.sources.bit_lines import edges_of_lines
from graphloom.sources.lines import lines, sectioned


def _first_word(c: str):
    return F.split(F.trim(c), r"\s+", 2)[0]


def edge_list(spark: SparkSession, path: str, directed: bool = True, delimiter: str = r"\s+") -> Graph:
    """``src dst [weight]`` a line; # starts a comment; a missing weight is 1."""
    p = F.split(F.trim("line"), delimiter)
    rows = lines(spark, path).where("trim(line) <> '' and not startswith(trim(line), '#')")
    return from_edges(rows.select(p[0].cast("long").alias("src"), p[1].cast("long").alias("dst"), F.coalesce(F.get(p, F.lit(2)).cast("double"), F.lit(1.0)).alias("weight")), directed)


def adjacency_list(spark: SparkSession, path: str, directed: bool = True, weighted: bool = False, delimiter: str = ":") -> Graph:
    """``id: n1 n2`` or, weighted, ``id: n1,w1 n2,w2``; # comments and blank lines are skipped; ids are text."""
    rows = lines(spark, path).where("trim(line) <> '' and not startswith(trim(line), '#')")
    p = F.split(F.col("line"), delimiter, 2)
    named = rows.select(F.trim(p[0]).alias("src"), F.explode_outer(F.filter(F.split(F.trim(F.coalesce(F.get(p, F.lit(1)), F.lit(""))), r"\s+"), lambda x: x != "")).alias("to"))
    q = F.split("to", ",")
    edges = named.where("to is not null").select("src", q[0].alias("dst"), (q[1].cast("double") if weighted else F.lit(1.0)).alias("weight"))
    vertices = named.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return from_edges(edges, directed, "first", vertices)


def adjacency_matrix(spark: SparkSession, path: str, directed: bool = True, delimiter: str = r"[,\s]+") -> Graph:
    """One row of numbers a line; 0 is no edge, the diagonal is ignored, undirected graphs read the upper triangle."""
    from graphloom.plans import running_total

    rows = lines(spark, path).where("trim(line) <> ''")
    numbered = running_total(rows, ["file"], [F.col("place")], F.lit(1).cast("long"), "src")
    cell = F.transform(F.split(F.trim("line"), delimiter), lambda x, i: F.when(x.cast("double") != 0, F.struct(i.cast("long").alias("dst"), x.cast("double").alias("weight"))))
    cells = numbered.select("src", F.explode(F.filter(cell, lambda x: x.isNotNull())).alias("c")).select("src", "c.dst", "c.weight")  # a row for each edge, none for a zero
    edges = cells.where("src <> dst" if directed else "src < dst")
    return Graph(numbered.select(F.col("src").alias("id")), edges, directed)


def matrix_market(spark: SparkSession, path: str) -> tuple[Graph, DataFrame]:
    """Coordinate format: the graph on 1 .. max(rows, columns), and the lines that could not be read."""
    text = lines(spark, path)
    head = text.where("startswith(line, '%%MatrixMarket')").first()
    if head is None:
        raise ValueError("no MatrixMarket header")
    kind = head["line"].lower().split()
    symmetric, pattern = kind[4] != "general", kind[3] == "pattern"
    body = text.where("not startswith(line, '%') and trim(line) <> ''").withColumn("p", F.split(F.trim("line"), r"\s+"))
    size = body.orderBy("place").first()
    n = max(int(size["p"][0]), int(size["p"][1]))
    rows = body.where(F.col("place") > F.struct(*(F.lit(size["place"][c]).cast("long").alias(c) for c in ("block", "n"))))
    src, dst = F.get("p", F.lit(0)).try_cast("long"), F.get("p", F.lit(1)).try_cast("long")
    weight = F.lit(1.0) if pattern else F.get("p", F.lit(2)).try_cast("double")
    read = rows.select(src.alias("src"), dst.alias("dst"), weight.alias("weight"), "line")
    good = F.col("src").isNotNull() & F.col("dst").isNotNull() & F.col("weight").isNotNull() & F.col("src").between(1, n) & F.col("dst").between(1, n)
    edges = read.where(good).select("src", "dst", "weight")
    return Graph(spark.range(1, n + 1), canonical(edges) if symmetric else edges, not symmetric), read.where(~F.coalesce(good, F.lit(False))).select("line")


def tgf(spark: SparkSession, path: str, directed: bool = True) -> tuple[Graph, DataFrame]:
    """``id label`` lines, #, then ``src dst [label]`` lines."""
    text = sectioned(lines(spark, path).where("trim(line) <> ''"), F.trim("line") == "#").where("is_header is null or not is_header")
    p = F.split(F.trim("line"), r"\s+", 2)
    vertices = text.where("header is null").select(p[0].alias("id"), F.get(p, F.lit(1)).alias("data"))
    q = F.split(F.trim("line"), r"\s+", 3)
    read = text.where("header is not null").select("line", q[0].alias("src"), F.get(q, F.lit(1)).alias("dst"), F.get(q, F.lit(2)).alias("weight"))
    edges = read.where("dst is not null").select("src", "dst", "weight")
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct().join(vertices, "id", "left_anti")
    vertices = vertices.dropDuplicates(["id"]).unionByName(ends, allowMissingColumns=True)
    return Graph(vertices, edges if directed else canonical(edges), directed), read.where("dst is null").select("line")


def pajek(spark: SparkSession, path: str) -> tuple[Graph, DataFrame]:
    """*Vertices, then *Arcs (directed) or *Edges; the first of the two decides the kind; % starts a comment."""
    text = sectioned(lines(spark, path).where("trim(line) <> '' and not startswith(trim(line), '%')"), F.startswith(F.trim("line"), F.lit("*"))).where("not is_header")
    kinds = lines(spark, path).where("lower(trim(line)) like '*arcs%' or lower(trim(line)) like '*edges%'").orderBy("place").first()
    directed = kinds is None or kinds["line"].strip().lower().startswith("*arcs")
    vertices = text.where("lower(header) like '*vertices%'").select(_first_word("line").cast("long").alias("id"), F.trim(F.regexp_replace("line", r'^\s*\S+\s*|"', "")).alias("data"))
    p = F.split(F.trim("line"), r"\s+")
    read = text.where(f"lower(header) like '{'*arcs' if directed else '*edges'}%'").select("line", p[0].try_cast("long").alias("src"), F.get(p, F.lit(1)).try_cast("long").alias("dst"), F.coalesce(F.get(p, F.lit(2)).try_cast("double"), F.lit(1.0)).alias("weight"))
    edges = read.where("src is not null and dst is not null").select("src", "dst", "weight")
    return Graph(vertices, edges if directed else canonical(edges), directed), read.where("src is null or dst is null").select("line")


def gdf(spark: SparkSession, path: str) -> Graph:
    """``nodedef>`` and ``edgedef>`` sections of comma-separated rows; a ``directed`` column decides the kind."""
    text = sectioned(lines(spark, path).where("trim(line) <> ''"), F.col("line").rlike("^(node|edge)def>"))
    heads = {r["header"].split("def>")[0]: [c.strip().split()[0] for c in r["header"].split("def>")[1].split(",")] for r in text.where("is_header").select("header").collect()}
    if "node" not in heads:
        raise ValueError("no nodedef section")
    part = lambda kind: text.where(f"not is_header and startswith(header, '{kind}def>')").select(*(F.get(F.split("line", ","), F.lit(i)).alias(c) for i, c in enumerate(heads.get(kind, ["x"]))))
    nodes, links = part("node"), part("edge")
    vertices = nodes.withColumnRenamed("name", "id")
    if "label" in vertices.columns:
        vertices = vertices.withColumnRenamed("label", "data")
    names = heads.get("edge", [])
    edges = links.select(F.col("node1").alias("src"), F.col("node2").alias("dst"), (F.col("weight") if "weight" in names else F.lit(None)).cast("double").alias("weight"))
    directed = "directed" in names and not links.where("lower(directed) = 'true'").isEmpty()
    return Graph(vertices, edges if directed else canonical(edges), directed)


def leda(spark: SparkSession, path: str) -> Graph:
    """LEDA.GRAPH: types, -1 (directed) or -2, node labels |{..}|, edges ``src dst reversal |{label}|``."""
    from graphloom.plans import running_total

    rows = lines(spark, path).where("trim(line) <> '' and not startswith(trim(line), '#')")
    numbered = running_total(rows, ["file"], [F.col("place")], F.lit(1).cast("long"), "n").select("n", F.trim("line").alias("line"))
    head = {r["n"]: r["line"] for r in numbered.where("n < 5").collect()}
    directed, count = head[3] == "-1", int(head[4])
    label = F.nullif(F.regexp_extract("line", r"\|\{(.*)\}\|", 1), F.lit(""))
    vertices = numbered.where((F.col("n") >= 5) & (F.col("n") < 5 + count)).select((F.col("n") - 4).alias("id"), label.alias("data"))
    p = F.split("line", r"\s+")
    edges = numbered.where(F.col("n") > 5 + count).select(p[0].cast("long").alias("src"), p[1].cast("long").alias("dst"), label.alias("weight"))
    return Graph(vertices, edges if directed else canonical(edges), directed)


def json_graph(spark: SparkSession, path: str) -> Graph:
    """One JSON document of nodes and edges (or links), ends named source/target or from/to, also nested under elements/data."""
    doc = spark.read.text(path, wholetext=True).select(F.col("value").alias("j"))
    item = lambda name: F.coalesce(*(F.from_json(F.get_json_object("j", p), "array<string>") for p in (f"$.elements.{name}", f"$.{name}")))
    of = lambda *names: F.coalesce(*(F.get_json_object("x", f"$.{p}{n}") for p in ("data.", "") for n in names))
    nodes = doc.select(F.explode(item("nodes")).alias("x")).select(of("id").alias("id"), of("label", "name", "data").alias("data"))
    links = doc.select(F.explode(F.coalesce(item("edges"), item("links"))).alias("x")).select(of("source", "from").alias("src"), of("target", "to").alias("dst"), of("weight", "value", "label").alias("weight"))
    flag = doc.select(F.coalesce(F.get_json_object("j", "$.directed") == "true", F.get_json_object("j", "$.graph_type") == "directed")).first()[0]
    directed = flag is None or flag
    return Graph(nodes, links if directed else canonical(links), directed)


def graphml(spark: SparkSession, path: str) -> Graph:
    """Nodes and edges by Spark's XML source; the kind from edgedefault; ``data`` keys label and weight are read."""
    key = lambda name: lines(spark, path).select(F.regexp_extract("line", rf'<key[^>]*id="([^"]+)"[^>]*attr.name="{name}"', 1).alias("k")).where("k <> ''").first()
    read = lambda tag, extra: spark.read.format("xml").option("rowTag", tag).schema(f"{extra}, data array<struct<_key string, _VALUE string>>").load(path)
    value = lambda name: F.filter("data", lambda d: d["_key"] == (key(name) or {"k": name})["k"])[0]["_VALUE"]
    directed = lines(spark, path).where("line like '%edgedefault=\"undirected\"%'").isEmpty()
    vertices = read("node", "_id string").select(F.col("_id").alias("id"), value("label").alias("data"))
    edges = read("edge", "_source string, _target string").select(F.col("_source").alias("src"), F.col("_target").alias("dst"), value("weight").alias("weight"))
    return Graph(vertices, edges if directed else canonical(edges), directed)


def gexf(spark: SparkSession, path: str) -> Graph:
    """Nodes and edges by Spark's XML source; the kind from defaultedgetype."""
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    directed = lines(spark, path).where("line like '%defaultedgetype=\"undirected\"%'").isEmpty()
    vertices = read("node", "_id string, _label string").select(F.col("_id").alias("id"), F.col("_label").alias("data"))
    edges = read("edge", "_source string, _target string, _weight double, _label string").select(F.col("_source").alias("src"), F.col("_target").alias("dst"), F.coalesce(F.col("_weight").cast("string"), "_label").alias("weight"))
    return Graph(vertices, edges if directed else canonical(edges), directed)


def _bit_lines(spark: SparkSession, path: str, prefix: bytes, sparse: bool) -> DataFrame:
    ship(spark)
    text = lines(spark, path).where("trim(line) <> ''").select(F.concat_ws(":", F.col("place.block"), F.col("place.n")).alias("graph"), F.trim("line").alias("line"))
    return text.mapInArrow(edges_of_lines(prefix, sparse), "graph string, n long, src long, dst long")


def graph6(spark: SparkSession, path: str) -> DataFrame:
    """(graph, n, src, dst) of the undirected graphs of a graph6 file, one a line; all by bit arithmetic on the text."""
    return _bit_lines(spark, path, rb"(>>graph6<<)?", False)


def sparse6(spark: SparkSession, path: str) -> DataFrame:
    """(graph, n, src, dst) of the undirected graphs of a sparse6 file, one a line; repeated edges stay repeated.

    A line is a row of pairs (b, x). The current vertex grows by b, and jumps
    to x where x is larger, else x is its neighbour.
    """
    return _bit_lines(spark, path, rb"((>>sparse6<<)?:)?", True)
