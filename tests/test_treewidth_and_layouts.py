"""Tree decompositions by their three rules, Tutte positions against a dense solver, quadtree pushes against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.graph import Graph, from_edges
from graphloom.operators import layout
from graphloom.operators.treewidth import tree_decomposition, treewidth_upper_bound

SCHEMA = "src long, dst long"


def graph_of(spark, rows, n=None):
    vertices = spark.createDataFrame([(i,) for i in range(n)], "id long") if n is not None else None
    return from_edges(spark.createDataFrame(rows, SCHEMA), False, vertices=vertices)


def grid(k):
    return [(r * k + c, r * k + c + 1) for r in range(k) for c in range(k - 1)] + [(r * k + c, r * k + c + k) for r in range(k - 1) for c in range(k)]


def holds(bags, tree, vertices, edges):
    of = {}
    for b, v in bags:
        of.setdefault(b, set()).add(v)
    assert len(bags) == sum(map(len, of.values())) and set(of) == {b for b, _ in tree} and len(tree) == len(of)
    assert set().union(*of.values()) == set(vertices)
    assert all(any({a, b} <= s for s in of.values()) for a, b in edges)
    up = dict(tree)
    for b in of:  # the way up ends
        seen = {b}
        while (b := up[b]) is not None:
            assert b not in seen
            seen.add(b)
    for v in vertices:
        mine = [b for b in of if v in of[b]]
        assert len(mine) - sum(up[b] is not None and v in of[up[b]] for b in mine) == 1
    return max(map(len, of.values())) - 1


def random_rows(seed, n, m):
    r = random.Random(seed)
    return [e for e in ((r.randrange(n), r.randrange(n)) for _ in range(m)) if e[0] != e[1]]


TREE = [(i, (i - 1) // 2) for i in range(1, 15)]
CASES = {
    "tree": (TREE, 15, 1, 1),
    "ring": ([(i, (i + 1) % 9) for i in range(9)], 9, 2, 2),
    "clique": ([(a, b) for a in range(7) for b in range(a)], 7, 6, 6),
    "grid": (grid(4), 16, 4, 5),
    "pieces": ([(0, 1), (1, 2), (2, 0), (3, 4), (5, 5)], 7, 2, 2),
    "random": (random_rows(3, 14, 30), 14, 2, 9),
}


@pytest.mark.parametrize("base", [0, 4, 1024])
@pytest.mark.parametrize("name", sorted(CASES))
def test_tree_decomposition(spark, name, base):
    rows, n, least, most = CASES[name]
    bags, tree = tree_decomposition(graph_of(spark, rows, n), base=base)
    width = holds([tuple(r) for r in bags.collect()], [tuple(r) for r in tree.collect()], range(n), rows)
    assert least <= width <= most


def test_treewidth_of_nothing_and_of_single_vertices(spark):
    none = graph_of(spark, [], 0)
    assert treewidth_upper_bound(none).first()["width"] == 0
    assert tree_decomposition(none)[1].count() == 0
    alone = graph_of(spark, [], 3)
    bags, tree = tree_decomposition(alone, base=0)
    assert treewidth_upper_bound(alone).first()["width"] == 0 and bags.count() == 3 == tree.where("parent is null").count()


def test_directions_and_loops_do_not_matter(spark):
    rows = [(0, 1), (1, 0), (1, 2), (2, 2), (0, 2)]
    g = from_edges(spark.createDataFrame(rows, SCHEMA), True)
    assert treewidth_upper_bound(g).first()["width"] == 2


def test_tutte_is_the_solution_of_the_means(spark):
    k = 5
    rows, n = grid(k), k * k
    outer = [0, 4, 24, 20]
    boundary = spark.createDataFrame([(v, i) for i, v in enumerate(outer)], "id long, place int")
    got = {r["id"]: (r["x"], r["y"]) for r in layout.tutte(graph_of(spark, rows, n), boundary, radius=2.0).collect()}
    a, rhs = np.eye(n), np.zeros((n, 2))
    for v in range(n):
        if v in outer:
            t = 2 * np.pi * outer.index(v) / 4
            rhs[v] = 2 * np.cos(t), 2 * np.sin(t)
        else:
            near = [y if x == v else x for x, y in rows if v in (x, y)]
            a[v, near] = -1 / len(near)
    want = np.linalg.solve(a, rhs)
    assert len(got) == n and np.allclose([got[v] for v in range(n)], want, atol=1e-6)


def test_tutte_leaves_pieces_without_a_boundary_at_the_centre(spark):
    g = graph_of(spark, [(0, 1), (1, 2), (2, 0), (0, 3), (1, 3), (2, 3), (4, 5)], 7)
    boundary = spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "id long, place int")
    got = {r["id"]: (r["x"], r["y"]) for r in layout.tutte(g, boundary).collect()}
    assert len(got) == 7 and all(got[v] == pytest.approx((0, 0), abs=1e-7) for v in (3, 4, 5, 6))
    whole = layout.tutte(graph_of(spark, [(0, 1), (1, 2), (2, 0)]), boundary)
    assert whole.count() == 3


@pytest.mark.parametrize("rows", [[(0, 0), (1, 1)], [(0, 0), (1, 1), (1, 2)], [(0, 0), (1, 1), (99, 2)]])
def test_tutte_wants_three_known_boundary_vertices(spark, rows):
    with pytest.raises(ValueError, match="boundary"):
        layout.tutte(graph_of(spark, [(0, 1), (1, 2), (2, 0)]), spark.createDataFrame(rows, "id long, place int"))


@pytest.mark.parametrize("spread", [1.0, 0.01])
def test_quadtree_pushes_like_all_pairs(spark, spread):
    r = np.random.default_rng(5)
    at = np.vstack([r.random((120, 2)), 0.3 + spread * 0.1 * r.random((120, 2))])
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "id long, x double, y double")
    got = {p["id"]: (p["px"], p["py"]) for p in layout.repulsion(points, 1.0, levels=18).collect()}
    d = at[:, None] - at[None]
    d2 = np.maximum((d**2).sum(axis=2), 0.25**18)
    want = (d / d2[:, :, None]).sum(axis=1)
    off = np.linalg.norm(np.array([got[i] for i in range(len(at))]) - want, axis=1)
    assert (off < 0.05 * np.linalg.norm(want, axis=1).max()).all()


def test_pushes_of_points_at_one_place(spark):
    points = spark.createDataFrame([(i, 0.5, 0.5) for i in range(4)] + [(4, 1.0, 1.0)], "id long, x double, y double")
    got = {p["id"]: (p["px"], p["py"]) for p in layout.repulsion(points, 1.0).collect()}
    assert len(got) == 5 and got[4][0] == pytest.approx(4.0) and got[0][0] == pytest.approx(-1.0)


def test_spring_draws_neighbours_together(spark):
    rows = [(a + k * 5, b + k * 5) for k in (0, 1) for a in range(5) for b in range(a)] + [(0, 5)]
    g: Graph = graph_of(spark, rows)
    at = {r["id"]: (r["x"], r["y"]) for r in layout.spring(g, 15).collect()}
    dist = lambda a, b: np.hypot(at[a][0] - at[b][0], at[a][1] - at[b][1])
    inside = np.mean([dist(a + k * 5, b + k * 5) for k in (0, 1) for a in range(5) for b in range(a)])
    across = np.mean([dist(a, b) for a in range(5) for b in range(5, 10)])
    assert len(at) == 10 and inside < across and g.vertices.where(F.col("id") > 9).isEmpty()
