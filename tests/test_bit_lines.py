"""graph6 and sparse6 lines in chunks against the formats' rules in plain Python, and lines of a length that took a pass for each character."""

import numpy as np
import pyarrow as pa
import pytest

from graphloom.sources import bit_lines, writers


def text(run, pairs):
    rows = [(-1, -1), *pairs]
    batch = pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.int64())], ["src", "dst"])
    return next(run(iter([batch]))).column("line")[0].as_py()


def back(line, sparse):
    batch = pa.RecordBatch.from_arrays([pa.array(["0:0"]), pa.array([line])], ["graph", "line"])
    prefix = rb"((>>sparse6<<)?:)?" if sparse else rb"(>>graph6<<)?"
    return sorted((r["src"], r["dst"]) for b in bit_lines.edges_of_lines(prefix, sparse)(iter([batch])) for r in b.to_pylist())


def plain_graph6(n, pairs):
    bits = "".join("1" if (i, j) in pairs else "0" for j in range(n) for i in range(j))
    bits += "0" * (-len(bits) % 6)
    return writers._size(n) + "".join(chr(63 + int(bits[i : i + 6], 2)) for i in range(0, len(bits), 6))


@pytest.mark.parametrize("n", [1, 2, 8, 16, 63, 64, 90])
def test_chunks_give_the_whole_line(monkeypatch, n):
    monkeypatch.setattr(bit_lines, "CHUNK", 6)
    rng = np.random.default_rng(n)
    pairs = sorted({(min(a, b), max(a, b)) for a, b in rng.integers(0, n, (2 * n, 2)).tolist() if a != b})
    line = text(bit_lines.graph6_line(n, writers._size(n)), pairs)
    assert line == plain_graph6(n, set(pairs)) and back(line, False) == pairs
    sparse = text(bit_lines.sparse6_line(n, ":" + writers._size(n)), pairs)
    assert back(sparse, True) == pairs


def test_a_line_of_many_edges_takes_one_pass():
    n = 60_000
    rng = np.random.default_rng(1)
    ends = np.unique(np.sort(rng.integers(0, n, (150_000, 2)), axis=1), axis=0)
    pairs = [tuple(p) for p in ends[ends[:, 0] < ends[:, 1]].tolist()]
    assert back(text(bit_lines.sparse6_line(n, ":" + writers._size(n)), pairs), True) == pairs


def test_zeros_of_a_matrix_are_not_sorted_or_made_rows(spark, tmp_path):
    from graphloom.graph import from_edges
    from graphloom.sources import readers

    rows = [(0, 2, 2.5), (2, 5, -1.0), (1, 5, 3.0)]
    g = from_edges(spark.createDataFrame(rows, "src long, dst long, weight double"), True, vertices=spark.range(7))
    lines = writers.adjacency_matrix(g)
    assert [r[0] for r in lines.collect()] == [" ".join(str({(a, b): w for a, b, w in rows}.get((i, j), 0.0)) for j in range(7)) for i in range(7)]
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("repeat(") < plan.index("Sort [")  # made above the sort
    writers.write_text(lines.coalesce(1), str(tmp_path / "m"))
    back = readers.adjacency_matrix(spark, str(tmp_path / "m"))
    assert sorted(tuple(r) for r in back.edges.collect()) == sorted(rows)
    assert "Generate explode(filter(" in back.edges._jdf.queryExecution().analyzed().toString()
