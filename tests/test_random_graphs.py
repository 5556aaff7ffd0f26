"""Random families by their properties, Leiden and the estimates by graphs whose answer is known."""

import pytest

from graphloom.graph import from_edges
from graphloom.operators import approximate, community, generators


def graph(spark, pairs):
    return from_edges(spark.createDataFrame(pairs, "src long, dst long"), False)


def pairs(g):
    return [(r["src"], r["dst"]) for r in g.edges.collect()]


def test_gnp_goes_on_past_one_round_of_skips(spark):
    e = pairs(generators.gnp(spark, 200, 0.9, 3))
    assert abs(len(e) - 0.9 * 19900) < 250 and all(a < b for a, b in e) and len(set(e)) == len(e)
    e = pairs(generators.gnp(spark, 150, 0.5, 3, True))
    assert abs(len(e) - 0.5 * 150 * 149) < 450 and any(a > b for a, b in e) and all(a != b for a, b in e)
    assert pairs(generators.gnp(spark, 30, 0.0, 3)) == [] and len(pairs(generators.gnp(spark, 10, 1.0, 3))) == 45


def test_block_models(spark):
    e = pairs(generators.block_model(spark, [100, 50], 0.4, 0.02, 5))
    inside = sum((a < 100) == (b < 100) for a, b in e)
    assert abs(inside - 0.4 * (4950 + 1225)) < 200 and abs(len(e) - inside - 100) < 50
    e = pairs(generators.nested_block_model(spark, 120, [2, 3], [0.0, 0.1, 1.0], 5))
    assert all(a // 60 == b // 60 for a, b in e) and sum(a // 20 == b // 20 for a, b in e) == 6 * 190
    with pytest.raises(ValueError):
        generators.nested_block_model(spark, 10, [3], [0.1, 0.1], 5)
    e = pairs(generators.degree_corrected_block_model(spark, [100, 300], 3000, 1.0, 5))
    assert all((a < 100) == (b < 100) for a, b in e) and all(a < b < 400 for a, b in e)


def test_geometric_by_all_pairs(spark):
    g = generators.geometric(spark, 150, 0.13, 5)
    at = {r["id"]: r["data"] for r in g.vertices.collect()}
    want = {(a, b) for a in at for b in at if a < b and (at[a]["x"] - at[b]["x"]) ** 2 + (at[a]["y"] - at[b]["y"]) ** 2 <= 0.13**2}
    assert set(pairs(g)) == want and want


def test_rewiring_keeps_degrees_and_moves_edges(spark):
    start = generators.regular(spark, 60, 4, 5, turns=0)
    e = pairs(generators.rewired(start, 3, 5))
    ends = [x for p in e for x in p]
    assert len(e) == len(set(e)) == 120 and all(ends.count(v) == 4 for v in range(60)) and len(set(e) & set(pairs(start))) < 90
    with pytest.raises(ValueError):
        generators.regular(spark, 5, 3, 1)


def test_leiden(spark):
    clique = lambda at: [(at + i, at + j) for i in range(5) for j in range(i + 1, 5)]
    g = graph(spark, clique(0) + clique(10) + clique(20) + [(4, 10), (14, 20), (24, 0)])
    found = {r["id"]: r["community"] for r in community.leiden(g).collect()}
    assert found == {v: v // 10 * 10 for v in found} and len(found) == 15
    assert community.leiden(graph(spark, [])).count() == 0


def test_estimates(spark):
    g = generators.gnp(spark, 60, 0.3, 5)
    cover = {r["id"] for r in approximate.vertex_cover(g).collect()}
    assert all(a in cover or b in cover for a, b in pairs(g))
    exact = community.transitivity(g).first()["transitivity"]
    assert abs(approximate.transitivity(g, 4000).first()["transitivity"] - exact) < 0.04
    assert approximate.transitivity(generators.complete(spark, 6), 50).first()["transitivity"] == 1
    assert approximate.transitivity(graph(spark, [(0, i) for i in range(1, 6)]), 50).first()["transitivity"] == 0
    assert approximate.transitivity(graph(spark, [(0, 1)]), 50).first()["transitivity"] == 0


def test_scores_from_all_pivots_are_exact(spark):
    from graphloom.operators import centrality

    g = graph(spark, [(1, 2), (2, 3), (3, 4), (2, 5), (5, 4)])
    exact = {r["id"]: r["score"] for r in centrality.closeness(g).collect()}
    found = {r["id"]: r["score"] for r in approximate.closeness(g, pivots=5).collect()}
    assert found == pytest.approx(exact)
    exact_harmonic = {r["id"]: r["score"] for r in centrality.harmonic(g).collect()}
    assert {r["id"]: r["score"] for r in approximate.harmonic(g, pivots=5).collect()} == pytest.approx(exact_harmonic)
    some = {r["id"]: r["score"] for r in approximate.closeness(g, pivots=2).collect()}
    assert set(some) == set(exact) and sum(x > 0 for x in some.values()) == 5


def test_cells(spark):
    from graphloom.operators import grids

    maze = ["..#", ".#.", "..."]
    cells = spark.createDataFrame([(r, c, x) for r, line in enumerate(maze) for c, x in enumerate(line)], "row long, col long, data string")
    e = set(pairs(grids.from_cells(cells, lambda a, b: (a == ".") & (b == "."))))
    assert e == {(0, 1), (0, 3), (3, 6), (6, 7), (7, 8), (5, 8)}
    assert (1, 4) not in set(pairs(grids.from_cells(cells, grids.avoiding("#"), directed=True))) and (4, 1) in set(pairs(grids.from_cells(cells, grids.into("."), directed=True)))
    assert len(pairs(grids.from_cells(cells, moves=grids.KNIGHT))) == 8 and len(pairs(grids.from_cells(cells, moves=grids.QUEEN))) == 20
    assert pairs(grids.from_cells(cells.where("false"))) == []
