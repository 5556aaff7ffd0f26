"""Flows, cuts and matchings against augmenting paths on small random graphs."""

import random

import pytest

from graphloom.graph import Graph, from_edges
from graphloom.operators import flow


def brute_flow(arcs, s, t):
    cap = {}
    for a, b, w in arcs:
        if a != b and w > 0:
            cap[a, b] = cap.get((a, b), 0) + w
            cap.setdefault((b, a), 0)
    total = 0
    while True:
        before, todo = {s: None}, [s]
        while todo and t not in before:
            x = todo.pop(0)
            for (a, b), c in cap.items():
                if a == x and c > 0 and b not in before:
                    before[b] = x
                    todo.append(b)
        if t not in before:
            return total
        x = t
        while before[x] is not None:
            cap[before[x], x] -= 1
            cap[x, before[x]] += 1
            x = before[x]
        total += 1


@pytest.mark.parametrize("directed", [True, False])
def test_max_flow_equals_min_cut(spark, directed):
    r = random.Random(3)
    rows = [(r.randrange(9), r.randrange(9), r.randrange(0, 7)) for _ in range(26)] + [(20, 21, 5)]
    g = from_edges(spark.createDataFrame(rows, "src long, dst long, weight long"), directed)
    arcs = [tuple(x) for x in g.arcs().select("src", "dst", "weight").collect()]
    f = flow.max_flow(g, 0, 8)
    got = {(x["src"], x["dst"]): x["flow"] for x in f.collect()}
    want = brute_flow(arcs, 0, 8)
    assert flow.flow_value(f, 0).first()["value"] == want
    caps = {(a, b): w for a, b, w in arcs}
    assert all(0 < x <= caps.get(k, 0) for k, x in got.items())
    for v in range(1, 8):
        assert sum(x for (a, _), x in got.items() if a == v) == sum(x for (_, b), x in got.items() if b == v)
    sides = flow.min_cut(g, 0, 8)
    assert flow.cut_edges(g, sides).agg({"weight": "sum"}).first()[0] in (want, None) and {x["id"] for x in sides.where("source_side").collect()} >= {0}


def test_no_path_and_missing_ends(spark):
    g = from_edges(spark.createDataFrame([(1, 2, 3), (4, 5, 1)], "src long, dst long, weight long"), True)
    assert flow.max_flow(g, 1, 5).isEmpty() and flow.max_flow(g, 1, 1).isEmpty() and flow.max_flow(g, 99, 2).isEmpty()


def test_maximum_matching(spark):
    edges = [(1, 11), (1, 12), (2, 11), (3, 12), (3, 13), (4, 13)]
    g = from_edges(spark.createDataFrame(edges, "src long, dst long"), False)
    sides = spark.createDataFrame([(x, 0) for x in (1, 2, 3, 4)] + [(x, 1) for x in (11, 12, 13)], "id long, side int")
    found = [tuple(x) for x in flow.maximum_matching(g, sides).collect()]
    assert len(found) == 3 and {*found} <= {*edges} and len({a for a, _ in found}) == len({b for _, b in found}) == 3
    empty = Graph(spark.createDataFrame([], "id long"), spark.createDataFrame([], "src long, dst long, weight long"), False)
    assert flow.maximum_matching(empty, sides.limit(0)).isEmpty()
