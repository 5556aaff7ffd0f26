"""One task's rounds in arrays choose the same arcs as the rounds over tables."""

import numpy as np
import pytest

from graphloom.graph import from_edges
from graphloom.operators import arborescence


@pytest.mark.parametrize("kind", ["long", "string"])
def test_a_task_chooses_the_arcs_of_the_rounds(spark, monkeypatch, kind):
    def tables(*_):
        raise AssertionError("pointer doubling over tables")

    rng = np.random.default_rng(7)
    ends = rng.integers(0, 40, (200, 2))
    rows = [(int(a), int(b), int(w)) for (a, b), w in zip(ends, rng.integers(1, 4, 200)) if a != b]
    rows += [(v, (v + 1) % 40, 1 if v % 5 else 9) for v in range(40)]
    df = spark.createDataFrame(rows, "src long, dst long, weight long")
    g = from_edges(df.selectExpr(f"cast(src as {kind}) src", f"cast(dst as {kind}) dst", "weight"), True, "min")
    root = 0 if kind == "long" else "0"
    with monkeypatch.context() as m:
        m.setattr(arborescence, "_on_cycles", tables)
        found = {tuple(r) for r in arborescence.minimum_arborescence(g, root).collect()}
    monkeypatch.setattr(arborescence, "BASE", 60)  # the first rounds over tables, the rest in a task
    assert {tuple(r) for r in arborescence.minimum_arborescence(g, root).collect()} == found
    monkeypatch.setattr(arborescence, "BASE", -1)
    assert {tuple(r) for r in arborescence.minimum_arborescence(g, root).collect()} == found and len(found) == 39
