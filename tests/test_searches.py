"""Searches in blocks against Dijkstra's in plain Python and against the rounds: parts small and large, whole and broken weights, directed and not."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.graph import from_edges
from graphloom.operators import centrality, paths, searches


def drawn(spark, kind, directed, n=90, m=260):
    """The graph and all its distances by pair."""
    rng = np.random.default_rng(3)
    ends = rng.integers(0, n, (m, 2))
    ends[:80, 0] = 5  # a hub
    weight = {"whole": rng.integers(1, 6, m).astype(float), "broken": rng.integers(1, 500, m) / 7, "one": np.ones(m), "zero": rng.integers(0, 3, m).astype(float)}[kind]
    least = {}
    for (a, b), w in zip([*ends.tolist(), (n, n + 1)], [*weight.tolist(), 1.0]):
        key = (f"v{a}", f"v{b}") if directed else tuple(sorted((f"v{a}", f"v{b}")))
        least[key] = min(w, least.get(key, w))
    g = from_edges(spark.createDataFrame([(a, b, w) for (a, b), w in least.items()], "src string, dst string, weight double"), directed, "min")
    near = {}
    for (a, b), w in least.items():
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).extend([] if directed else [(a, w)])
    return g, {(s, v): d for s in near for v, d in dijkstra(near, s).items()}


def dijkstra(near, source):
    dist, heap = {}, [(0.0, source)]
    while heap:
        d, v = heapq.heappop(heap)
        if v not in dist:
            dist[v] = d
            for x, w in near.get(v, []):
                heapq.heappush(heap, (d + w, x))
    return dist


def table(df, *keys):
    return {tuple(r[k] for k in keys): r[-1] for r in df.collect()}


@pytest.mark.parametrize(("kind", "directed"), [("whole", False), ("broken", True), ("zero", False)])
def test_distances_are_the_shortest_and_take_no_rounds(spark, monkeypatch, kind, directed):
    def rounds(*_, **__):
        raise AssertionError("a round over all pairs")

    for name in ("fixpoint", "spread"):
        monkeypatch.setattr(paths, name, rounds)
    g, want = drawn(spark, kind, directed)
    found = paths.distance_matrix(g, g.vertices).collect()
    assert len(found) == len(want) and all(r["dist"] == pytest.approx(want[r["source"], r["id"]]) for r in found)
    counted = paths.distance_counts(g, g.vertices).agg(F.sum("n"), F.sum(F.col("n") * F.col("dist"))).first()
    assert counted[0] == len(want) and counted[1] == pytest.approx(sum(want.values()))


def test_several_tasks_and_blocks_agree(spark, monkeypatch):
    for name, value in {"ONE": 0, "SMALL": 2, "WIDEST": 64, "STEP": 96, "BATCH": 50}.items():
        monkeypatch.setattr(searches, name, value)
    g, want = drawn(spark, "one", True, n=150, m=500)
    assert table(paths.all_pairs_hops(g), "source", "id") == want
    per = table(paths.distance_counts(g, g.vertices, "id").where("dist > 0").groupBy("id").agg(F.sum("n").alias("n")), "id")
    assert per == {(v,): sum(k[1] == v and d > 0 for k, d in want.items()) for v in {k[1] for k, d in want.items() if d}}


def test_a_part_that_no_task_holds_goes_by_rounds(spark, monkeypatch):
    g, want = drawn(spark, "one", False, n=12, m=14)
    scores = table(centrality.betweenness(g), "id"), table(centrality.edge_betweenness(g), "src", "dst")
    monkeypatch.setattr(searches, "MAX_ARCS", 4)
    assert table(paths.distances(g, g.vertices), "source", "id") == want
    assert table(paths.all_pairs_hops(g), "source", "id") == want
    assert table(centrality.betweenness(g), "id") == pytest.approx(scores[0])
    assert table(centrality.edge_betweenness(g), "src", "dst") == pytest.approx(scores[1])
