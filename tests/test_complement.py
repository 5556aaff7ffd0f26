"""The complement makes its pairs in place: none are shuffled to be held against the edges."""

import pytest

from graphloom.graph import from_edges
from graphloom.operators import transforms


@pytest.mark.parametrize("directed", [False, True])
def test_pairs_of_a_complement_are_not_shuffled(spark, directed):
    pairs = [(0, 1), (1, 3), (2, 2), (4, 0), (5, 3)]
    g = from_edges(spark.createDataFrame(pairs, "src long, dst long"), directed, vertices=spark.range(7))
    out = transforms.complement(g).edges
    held = set(pairs) if directed else {tuple(sorted(p)) for p in pairs}
    assert sorted((r["src"], r["dst"]) for r in out.collect()) == [(a, b) for a in range(7) for b in range(7) if (a != b if directed else a < b) and (a, b) not in held]
    assert "LeftAnti" not in out._jdf.queryExecution().optimizedPlan().toString()
