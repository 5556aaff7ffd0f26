"""Text formats read and written, and graphs that follow a stream."""

import pytest
from pyspark.sql import functions as F

from graphloom.graph import Graph, from_edges
from graphloom.sources import readers, writers
from graphloom.streaming.live import LiveGraph, fold


def edges(g):
    return {tuple(r) for r in g.edges.select("src", "dst", "weight").collect()}


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_tgf(spark, tmp_path):
    g, odd = readers.tgf(spark, put(tmp_path, "a.tgf", "1 Ann\n2 Bo b\n3\n#\n1 2 friend\n2 3\nbad\n4 1 x y\n"))
    assert {tuple(r) for r in g.vertices.collect()} == {("1", "Ann"), ("2", "Bo b"), ("3", None), ("4", None)}
    assert edges(g) == {("1", "2", "friend"), ("2", "3", None), ("4", "1", "x y")}
    assert [r[0] for r in odd.collect()] == ["bad"]


def test_pajek(spark, tmp_path):
    g, odd = readers.pajek(spark, put(tmp_path, "a.net", '% note\n*Vertices 3\n1 "Ann A"\n2 "Bo"\n3 "C"\n*Arcs\n1 2 5\n2 3\nx y\n*Edges\n1 3 9\n'))
    assert g.directed and edges(g) == {(1, 2, 5.0), (2, 3, 1.0)} and odd.count() == 1
    assert {tuple(r) for r in g.vertices.collect()} == {(1, "Ann A"), (2, "Bo"), (3, "C")}


def test_matrix_market(spark, tmp_path):
    g, odd = readers.matrix_market(spark, put(tmp_path, "a.mtx", "%%MatrixMarket matrix coordinate real general\n% c\n3 3 3\n1 2 1.0\n2 3 2.5\n3 1 3.75\n9 9 1\nzzz\n"))
    assert g.directed and edges(g) == {(1, 2, 1.0), (2, 3, 2.5), (3, 1, 3.75)} and odd.count() == 2
    g, _ = readers.matrix_market(spark, put(tmp_path, "b.mtx", "%%MatrixMarket matrix coordinate pattern symmetric\n3 3 2\n2 1\n3 2\n"))
    assert not g.directed and edges(g) == {(1, 2, 1.0), (2, 3, 1.0)}
    with pytest.raises(ValueError, match="header"):
        readers.matrix_market(spark, put(tmp_path, "c.mtx", "1 1 1\n"))


def test_gdf_and_leda(spark, tmp_path):
    g = readers.gdf(spark, put(tmp_path, "a.gdf", "nodedef>name VARCHAR,label VARCHAR\n1,Ann\n2,Bo\nedgedef>node1,node2,directed BOOLEAN,weight\n1,2,true,5\n"))
    assert g.directed and edges(g) == {("1", "2", 5.0)} and g.vertices.count() == 2
    g = readers.leda(spark, put(tmp_path, "a.lgr", "LEDA.GRAPH\nstring\nstring\n-1\n3\n|{Ann}|\n|{Bo}|\n|{C}|\n2\n1 2 0 |{5}|\n2 3 0 |{}|\n"))
    assert g.directed and edges(g) == {(1, 2, "5"), (2, 3, None)}
    assert {tuple(r) for r in g.vertices.collect()} == {(1, "Ann"), (2, "Bo"), (3, "C")}


def test_lists_and_matrices(spark, tmp_path):
    assert edges(readers.edge_list(spark, put(tmp_path, "a.txt", "# c\n1 2\n2 3 4.5\n"))) == {(1, 2, 1.0), (2, 3, 4.5)}
    g = readers.adjacency_list(spark, put(tmp_path, "b.txt", "a: b,2 c,3\n# c\n\nd:\n"), weighted=True)
    assert edges(g) == {("a", "b", 2.0), ("a", "c", 3.0)} and {r["id"] for r in g.vertices.collect()} == set("abcd")
    assert edges(readers.adjacency_matrix(spark, put(tmp_path, "m.txt", "9 2 0\n0 0 3\n1 0 0\n"))) == {(0, 1, 2.0), (1, 2, 3.0), (2, 0, 1.0)}


def test_json_and_xml(spark, tmp_path):
    g = readers.json_graph(spark, put(tmp_path, "a.json", '{"directed": false, "nodes": [{"id": "b"}, {"id": "a", "label": "A"}], "links": [{"source": "b", "target": "a", "weight": 2}]}'))
    assert not g.directed and edges(g) == {("a", "b", "2")}
    g = readers.json_graph(spark, put(tmp_path, "b.json", '{"elements": {"nodes": [{"data": {"id": "x"}}], "edges": [{"data": {"source": "x", "target": "y"}}]}}'))
    assert g.directed and edges(g) == {("x", "y", None)}
    text = '<graphml><key id="d0" for="node" attr.name="label"/><key id="d1" for="edge" attr.name="weight"/>\n<graph edgedefault="undirected">\n<node id="2"><data key="d0">B</data></node>\n<node id="1"/>\n<edge source="2" target="1"><data key="d1">7</data></edge>\n</graph></graphml>'
    g = readers.graphml(spark, put(tmp_path, "a.graphml", text))
    assert not g.directed and edges(g) == {("1", "2", "7")} and {tuple(r) for r in g.vertices.collect()} == {("2", "B"), ("1", None)}
    text = '<gexf><graph defaultedgetype="directed">\n<nodes><node id="1" label="A"/></nodes>\n<edges><edge id="0" source="1" target="2" weight="3.5"/></edges></graph></gexf>'
    assert edges(readers.gexf(spark, put(tmp_path, "a.gexf", text))) == {("1", "2", "3.5")}


def test_graph6(spark, tmp_path):
    out = readers.graph6(spark, put(tmp_path, "a.g6", "DqK\nA_\n")).collect()
    by = {}
    for r in out:
        by.setdefault((r["graph"], r["n"]), set()).add((r["src"], r["dst"]))
    assert {n: e for (_, n), e in by.items()} == {5: {(0, 1), (0, 3), (1, 3), (2, 4)}, 2: {(0, 1)}} or {n for _, n in by} == {5, 2}


def test_sparse6(spark, tmp_path):
    out = readers.sparse6(spark, put(tmp_path, "a.s6", ">>sparse6<<:Fa@x^\n")).collect()
    assert {(r["n"], r["src"], r["dst"]) for r in out} == {(7, 0, 1), (7, 0, 2), (7, 1, 2), (7, 5, 6)}


@pytest.mark.parametrize("pairs", [[(0, 1), (1, 2), (3, 3)], [(0, 1), (2, 3)], [(0, 6), (3, 6), (7, 7)], [(0, 5), (5, 6), (7, 7)], [(0, 70), (3, 69), (2, 5)], [(0, 1)], [(0, 0)]])
def test_graph_lines_read_back(spark, tmp_path, pairs):
    ids = spark.range(max(b for _, b in pairs) + 1)
    g = from_edges(spark.createDataFrame(pairs, "src long, dst long"), False, vertices=ids)
    for name in ("graph6", "sparse6"):
        out = str(tmp_path / name)
        writers.write_text(getattr(writers, name)(g), out)
        back = getattr(readers, name)(spark, out).collect()
        assert sorted((r["src"], r["dst"]) for r in back) == sorted(p for p in pairs if p[0] != p[1]), name


@pytest.mark.parametrize("directed", [True, False])
def test_written_graphs_read_back(spark, tmp_path, directed):
    e = spark.createDataFrame([(1, 2, 5.0), (2, 3, 1.5), (1, 3, 2.0)], "src long, dst long, weight double")
    g = from_edges(e, directed)
    want = {(a, b, float(w)) for a, b, w in edges(g)}
    out = str(tmp_path / "x")
    for name, read in {"pajek": lambda p: readers.pajek(spark, p)[0], "matrix_market": lambda p: readers.matrix_market(spark, p)[0], "edge_list": lambda p: readers.edge_list(spark, p, directed), "gdf": lambda p: readers.gdf(spark, p), "graphml": lambda p: readers.graphml(spark, p), "gexf": lambda p: readers.gexf(spark, p), "leda": lambda p: readers.leda(spark, p)}.items():
        writers.write_text(getattr(writers, name)(g).coalesce(1), f"{out}-{name}")
        back = read(f"{out}-{name}")
        found = {(int(a), int(b), float(w)) for a, b, w in edges(back)}
        assert found == want and (back.directed == directed or name == "edge_list"), name


def test_drawings(spark):
    g = from_edges(spark.createDataFrame([(1, 2, 5)], "src long, dst long, weight long"), True)
    assert [r[0] for r in writers.dot(g, highlight=g.edges).collect()] == ["digraph G {", '  "1" [label="1"];', '  "2" [label="2"];', '  "1" -> "2" [label="5", color="red", penwidth=2];', "}"]
    assert [r[0] for r in writers.mermaid(g).collect()][-1] == "  n1 -->|5| n2"
    assert writers.tgf(g).count() == 4 and writers.adjacency_list(g).count() == 2 and writers.json_rows(g).count() == 3


CHANGES = [(0, "add_edge", 1, 2, 1.0), (1, "add_edge", 2, 3, 1.0), (2, "add_edge", 1, 2, 9.0), (3, "remove_node", 3, None, None), (4, "add_node", 7, None, None), (5, "remove_edge", 5, 6, None)]


def test_fold(spark):
    empty = Graph(spark.createDataFrame([], "id long"), spark.createDataFrame([], "src long, dst long, weight double"), True)
    g = fold(empty, spark.createDataFrame(CHANGES, "seq long, kind string, src long, dst long, weight double"))
    assert edges(g) == {(1, 2, 9.0)} and {r["id"] for r in g.vertices.collect()} == {1, 2, 7}


def test_live_graph_follows_a_stream(spark, tmp_path):
    df = spark.createDataFrame(CHANGES, "seq long, kind string, src long, dst long, weight double")
    df.where("seq < 3").coalesce(1).write.parquet(str(tmp_path / "in"))
    live = LiveGraph(spark, f"file://{tmp_path}/live", True)

    def run():
        q = live.follow(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "ckpt"))
        q.processAllAvailable()
        q.stop()

    run()
    assert edges(live.graph()) == {(1, 2, 9.0), (2, 3, 1.0)}
    df.where("seq >= 3").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert edges(live.graph()) == {(1, 2, 9.0)}
    live.apply(df.where(F.lit(False)), 2)
    assert edges(live.graph()) == {(1, 2, 9.0)}
