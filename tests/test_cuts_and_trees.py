"""Global cuts, arborescences and dominators against brute force on small random graphs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from graphloom.graph import Graph, from_edges
from graphloom.operators.arborescence import minimum_arborescence
from graphloom.operators.cuts import global_min_cut
from graphloom.operators.dominators import dominators

SCHEMA = "src long, dst long, weight long"


def random_edges(seed, n, m, most=9):
    r = random.Random(seed)
    return [(r.randrange(n), r.randrange(n), r.randint(1, most)) for _ in range(m)]


def graph_of(spark, rows, directed, n=None):
    vertices = spark.createDataFrame([(i,) for i in range(n)], "id long") if n is not None else None
    return from_edges(spark.createDataFrame(rows, SCHEMA), directed, "max" if directed else "sum", vertices)


def cut_value(rows, side):
    return sum(w for a, b, w in rows if (a in side) != (b in side))


def brute_cut(rows, n):
    return min(cut_value(rows, {0, *rest}) for k in range(n - 1) for rest in itertools.combinations(range(1, n), k))


def summed(g):
    return [tuple(r) for r in g.edges.select("src", "dst", "weight").collect()]


@pytest.mark.parametrize(("seed", "base"), [(1, 64), (2, 64)])
def test_global_min_cut(spark, seed, base):
    n = 9
    ring = [(i, (i + 1) % n, 2) for i in range(n)]
    rows = ring + [e for e in random_edges(seed, n, 12) if e[0] != e[1]]
    g = graph_of(spark, rows, False, n)
    side = {r["id"] for r in global_min_cut(g, base=base).where("source_side").collect()}
    assert 0 < len(side) < n and cut_value(summed(g), side) == brute_cut(rows, n)


def test_global_min_cut_between_two_cliques(spark):
    """The least cut is no single vertex; a ring of weight beyond keeps safe contractions from doing all."""
    half = 7
    rows = [(a + k * half, b + k * half, 3) for k in (0, 1) for a in range(half) for b in range(a)] + [(0, half, 2), (1, half + 1, 2), (2, half + 2, 1)]
    side = {r["id"] for r in global_min_cut(graph_of(spark, rows, False)).where("source_side").collect()}
    assert side in ({*range(half)}, {*range(half, 2 * half)})


def test_random_contractions_find_the_cut_of_a_ring(spark):
    rows = [(i, (i + 1) % 10, 5) for i in range(10)]
    rows[3], rows[7] = (3, 4, 3), (7, 8, 3)
    g = graph_of(spark, rows, False)
    side = {r["id"] for r in global_min_cut(g, base=7).where("source_side").collect()}
    assert side in (set(range(4, 8)), set(range(10)) - set(range(4, 8)))


def test_global_min_cut_of_pieces_and_points(spark):
    two = graph_of(spark, [(0, 1, 4), (2, 3, 4)], False)
    assert {tuple(r) for r in global_min_cut(two).collect()} == {(0, True), (1, True), (2, False), (3, False)}
    assert [tuple(r) for r in global_min_cut(graph_of(spark, [], False, 1)).collect()] == [(0, True)]
    assert global_min_cut(graph_of(spark, [], False, 0)).count() == 0
    with pytest.raises(ValueError, match="undirected"):
        global_min_cut(graph_of(spark, [(0, 1, 1)], True))


def brute_arborescence(arcs, n, root):
    into = [[(a, w) for a, b, w in arcs if b == v and a != v] for v in range(n) if v != root]
    names, best = [v for v in range(n) if v != root], None
    for choice in itertools.product(*into):
        up = {v: a for v, (a, _) in zip(names, choice)}
        ok = True
        for v in names:
            x = v
            for _ in range(n):
                if x == root:
                    break
                x = up[x]
            ok = ok and x == root
        total = sum(w for _, w in choice)
        if ok and (best is None or total < best):
            best = total
    return best


@pytest.mark.parametrize("seed", range(3))
def test_minimum_arborescence(spark, seed):
    n = 7
    r = random.Random(seed)
    rows = [(0, 1, 9)] + random_edges(seed, n, 15) + [(v, v % 6 + 1, 1 + r.randrange(3)) for v in range(1, n)]  # a cheap cycle
    g = graph_of(spark, rows, True, n)
    found = [tuple(x) for x in minimum_arborescence(g, 0).collect()]
    up = {b: a for a, b, _ in found}
    assert len(found) == n - 1 and len(up) == n - 1 and 0 not in up
    for v in range(1, n):
        for _ in range(n):
            v = up.get(v, 0)
        assert v == 0
    assert sum(w for _, _, w in found) == brute_arborescence(summed(g), n, 0)


def test_nested_cycles_unfold(spark):
    """Cycles {1, 2}, then with 3, then with 4; only one dear arc leads in from the root."""
    rows = [(1, 2, 1), (2, 1, 1), (2, 3, 2), (3, 1, 2), (3, 4, 3), (4, 2, 3), (0, 4, 50), (0, 3, 60)]
    found = {tuple(x) for x in minimum_arborescence(graph_of(spark, rows, True), 0).collect()}
    assert sum(w for _, _, w in found) == brute_arborescence(rows, 5, 0)


def test_no_arborescence(spark):
    with pytest.raises(ValueError, match="reach"):
        minimum_arborescence(graph_of(spark, [(0, 1, 1), (2, 3, 1), (3, 2, 1)], True), 0)
    with pytest.raises(ValueError, match="root"):
        minimum_arborescence(graph_of(spark, [(0, 1, 1)], True), 7)
    assert minimum_arborescence(graph_of(spark, [], True, 1), 0).count() == 0


def brute_dominators(arcs, start):
    def reach(without):
        seen, todo = set(), [start] if start != without else []
        while todo:
            v = todo.pop()
            if v not in seen:
                seen.add(v)
                todo += [b for a, b, _ in arcs if a == v and b != without]
        return seen

    all_ = reach(None)
    doms = {v: {x for x in all_ if x == v or v not in reach(x)} for v in all_}
    return {(v, v if v == start else max(doms[v] - {v}, key=lambda x: len(doms[x]))) for v in all_}


@pytest.mark.parametrize("seed", range(2))
def test_dominators(spark, seed):
    rows = random_edges(seed, 14, 20) + [(i, i + 1, 1) for i in range(0, 13, 2)] + [(0, 3, 1), (3, 8, 1)]
    g = graph_of(spark, rows, True, 15)
    assert {tuple(r) for r in dominators(g, 0).collect()} == brute_dominators(summed(g), 0)


def test_dominators_of_chains_and_nothing(spark):
    chain = graph_of(spark, [(i, i + 1, 1) for i in range(9)] + [(0, 0, 1)], True)
    assert {tuple(r) for r in dominators(chain, 0).collect()} == {(0, 0), *((i + 1, i) for i in range(9))}
    assert dominators(chain, 99).count() == 0
    assert [tuple(r) for r in dominators(graph_of(spark, [], True, 2), 1).collect()] == [(1, 1)]
