"""Assignments against enumeration, graphs that are never built, labels in batches, and grids that close on themselves."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from graphloom.graph import from_edges
from graphloom.operators import grids, implicit, paths
from graphloom.operators.assignment import assignment, assignment_with_prices
from graphloom.sources.labels import Labels


def best_total(costs: dict, n: int, m: int, maximise: bool):
    """By trying all injections of the smaller side into the larger."""
    if n > m:
        costs, n, m = {(j, i): c for (i, j), c in costs.items()}, m, n
    totals = [sum(costs[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n) if all((i, p[i]) in costs for i in range(n))]
    return (max if maximise else min)(totals) if totals else None


@pytest.mark.parametrize("n,m,maximise,seed", [(4, 4, False, 1), (3, 5, False, 2), (5, 3, True, 3)])
def test_assignment_is_the_best_one(spark, n, m, maximise, seed):
    rng = random.Random(seed)
    costs = {(i, j): rng.randint(-20, 20) for i in range(n) for j in range(m) if rng.random() < 0.9}
    want = best_total(costs, n, m, maximise)
    assert want is not None
    pairs, prices = assignment_with_prices(spark.createDataFrame([(i, j, c) for (i, j), c in costs.items()], "left long, right long, cost long"), maximise)
    got = pairs.collect()
    assert len(got) == min(n, m) == len({r["left"] for r in got}) == len({r["right"] for r in got})
    assert sum(r["cost"] for r in got) == want
    of = {(r["side"], r["id"]): r["price"] for r in prices.collect()}
    sign = -1 if maximise else 1
    assert all(sign * (of["left", i] + of["right", j] - c) < 1e-9 for (i, j), c in costs.items())
    assert abs(sum(of.values()) - want) < 1
    if n != m:
        assert all(sign * p < 1e-9 for (side, _), p in of.items() if side == ("left" if n > m else "right"))


def test_assignment_of_labels_nulls_repeats_and_extra_columns(spark):
    rows = [("a", "x", 10), ("a", "y", 19), ("a", "z", 8), ("b", "x", 15), ("b", "y", 17), ("b", "z", 12), ("c", "x", 8), ("c", "y", 18), ("c", "z", 9)]
    more = rows + [("a", "x", 40), ("a", "x", 10), (None, "x", 0), ("a", None, 0), ("b", "x", None)]
    costs = spark.createDataFrame(more, "left string, right string, cost int").withColumn("price", F.lit("extra"))
    assert sum(r["cost"] for r in assignment(costs).collect()) == 33
    assert assignment(costs.limit(0)).count() == 0


def test_assignment_that_does_not_exist(spark):
    with pytest.raises(ValueError, match="no assignment"):
        assignment(spark.createDataFrame([(1, 1, 5), (2, 1, 3), (3, 2, 1), (3, 3, 1)], "left long, right long, cost long"))
    with pytest.raises(ValueError, match="whole numbers"):
        assignment(spark.createDataFrame([(1, 1, 0.5)], "left long, right long, cost double"))


def test_explore_counts_like_a_built_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 6)], "src long, dst long")
    start = spark.createDataFrame([(1,)], "id long")
    step = lambda s: s.join(edges, s["id"] == edges["src"]).select(F.col("dst").alias("id"))
    built = paths.bfs(from_edges(edges, True), start).select("id", "depth")
    assert sorted(map(tuple, implicit.explore(start, step).collect())) == sorted(map(tuple, built.collect()))
    assert sorted(r["id"] for r in implicit.explore(start, step, max_depth=1).collect()) == [1, 2]
    assert sorted(r["id"] for r in implicit.explore(start, step, goal=F.col("id") == 3).collect()) == [1, 2, 3]
    assert [r["id"] for r in implicit.explore(start, step, max_depth=0).collect()] == [1]


def test_explore_by_key_and_with_nulls(spark):
    start = spark.createDataFrame([(0, None), (0, None)], "n long, way string")
    step = lambda s: s.select((F.col("n") + 1).alias("n"), F.explode(F.array(F.lit("l"), F.lit("r"))).alias("way"))
    found = implicit.explore(start, step, visited_by={"k": F.col("n") % 3}).collect()
    assert sorted(map(tuple, found), key=lambda r: r[0]) == [(0, None, 0), (1, "l", 1), (2, "l", 2)]
    assert implicit.explore(start, step, max_depth=2).count() == 1 + 2 + 2
    assert implicit.explore(start.limit(0), step).count() == 0


def test_least_costs_on_numbers(spark):
    """From 1: double for 3, add one for 2; the states up to 20."""
    def step(s):
        moves = F.explode(F.array(F.struct((F.col("n") * 2).alias("n"), F.lit(3.0).alias("c")), F.struct((F.col("n") + 1).alias("n"), F.lit(2.0).alias("c")))).alias("m")
        return s.select("cost", moves).select(F.col("m.n").alias("n"), (F.col("cost") + F.col("m.c")).alias("cost")).where("n <= 20")

    want = {1: 0.0}
    for n in range(2, 21):
        want[n] = min(want[n - 1] + 2, want[n // 2] + 3 if n % 2 == 0 else 1e9)
    got = implicit.least_costs(spark.createDataFrame([(1, 0.0)], "n long, cost double"), step)
    assert {r["n"]: r["cost"] for r in got.collect()} == want


def test_labels_keep_their_ids(spark, tmp_path):
    labels = Labels(spark, f"file://{tmp_path}/labels")
    edges = lambda *rows: spark.createDataFrame(list(rows), "src string, dst string, weight long")
    g = labels.graph(edges(("b", "a", 2), ("c", "a", 3), (None, "z", 1)), True)
    first = {r["data"]: r["id"] for r in g.vertices.collect()}
    assert first == {"a": 0, "b": 1, "c": 2, "z": 3}
    assert sorted(map(tuple, g.edges.collect())) == [(1, 0, 2), (2, 0, 3)]
    second = {r["label"]: r["id"] for r in labels.add(spark.createDataFrame([("0",), ("a",), ("y",), ("0",), (None,)], "label string")).collect()}
    assert second == first | {"0": 4, "y": 5}
    again = {r["label"]: r["id"] for r in Labels(spark, f"file://{tmp_path}/labels").add(spark.createDataFrame([], "label string")).collect()}
    assert again == second


def test_a_torus_of_cells(spark):
    cells = spark.createDataFrame([(r, c, 0) for r in range(3) for c in range(4)], "row long, col long, data long")
    g = grids.from_cells(cells, wrap=True)
    got = {(r["src"], r["dst"]) for r in g.edges.collect()}
    want = {tuple(sorted((r * 4 + c, x))) for r in range(3) for c in range(4) for x in ((r + 1) % 3 * 4 + c, r * 4 + (c + 1) % 4)}
    assert got == want and len(got) == 24
    narrow = grids.from_cells(spark.createDataFrame([(0, 0, 0), (0, 1, 0)], "row long, col long, data long"), wrap=True)
    assert [(r["src"], r["dst"]) for r in narrow.edges.collect()] == [(0, 1)]
