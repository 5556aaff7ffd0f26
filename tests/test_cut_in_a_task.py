"""Exact cuts by scans against all cuts of small graphs, and in place of rounds."""

import itertools

import numpy as np
import pytest

from graphloom.graph import from_edges
from graphloom.operators import cuts


@pytest.mark.parametrize("seed", range(40))
def test_scans_find_a_least_cut(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 10))
    w = np.triu(rng.integers(0, 4, (n, n)) * (rng.random((n, n)) < 0.6), 1)
    w[np.arange(n - 1), np.arange(1, n)] += 1  # connected
    a, b = np.nonzero(w)
    value, side = cuts.scanned_cut(n, a, b, w[a, b].astype(float))
    least = min(sum(w[i, j] + w[j, i] for i in range(n) for j in range(n) if i in s and j not in s) for k in range(1, n) for s in map(set, itertools.combinations(range(n), k)))
    assert value == least == w[a, b][side[a] != side[b]].sum()
    assert 0 < side.sum() < n


def test_a_task_cuts_a_graph_whose_edges_all_seem_partable(spark, monkeypatch):
    def runs(*_):
        raise AssertionError("random contractions")

    monkeypatch.setattr(cuts, "_contracted", runs)
    rows = [(i, (i + d) % 100, 1) for i in range(100) for d in (1, 7)]
    g = from_edges(spark.createDataFrame(rows, "src long, dst long, weight long"), False)
    side = {r["id"] for r in cuts.global_min_cut(g).where("source_side").collect()}
    assert sum((a in side) != (b in side) for a, b, _ in rows) == 4 and 0 < len(side) < 100
