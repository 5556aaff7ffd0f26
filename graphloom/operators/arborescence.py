"""Minimum arborescence: cheapest arcs in, cycles found by pointer doubling and contracted, and unfolded in reverse."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType

from graphloom.graph import Graph
from graphloom.plans import drop_saved, save, ship

#: Arcs between contracted vertices that one task finishes.
BASE = 1 << 21


def _on_cycles(step: DataFrame, n: int) -> DataFrame:
    """(id, cycle) of the vertices on cycles of a function (id, to): cycle is the smallest member.

    After as many steps as there are vertices only vertices on cycles are met,
    and the least id on as many steps along a cycle is the cycle's. Both come by
    doubling; vertices whose way ends (at the root) are dropped on the way.
    """
    jump = save(step.select("id", "to", F.least("id", "to").alias("least")), "jump")
    for _ in range(max(1, n).bit_length()):
        on = jump.select(F.col("id").alias("to"), F.col("to").alias("further"), F.col("least").alias("more"))
        old, jump = jump, save(jump.join(on, "to").select("id", F.col("further").alias("to"), F.least("least", "more").alias("least")), "jump")
        drop_saved(old)
    met = jump.select(F.col("to").alias("id")).distinct()
    return jump.join(met, "id", "left_semi").select("id", F.col("least").alias("cycle"))


def contracted(n: int, root: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray | None:
    """Places of the arcs (a, b, w) of a minimum arborescence of n vertices, of equal ones the first; none if there is none."""
    first, live, names, seen = b, np.arange(len(a)), np.arange(n), []
    while True:
        order = np.lexsort((w, b))
        picked = order[np.r_[True, b[order][1:] != b[order][:-1]]] if len(b) else order
        if len(picked) != len(np.unique(names)) - 1:
            return None
        to = np.arange(n)
        to[b[picked]] = a[picked]
        least, far = np.minimum(np.arange(n), to), to.copy()
        for _ in range(n.bit_length()):
            least, far = np.minimum(least, least[far]), far[far]
        on = np.zeros(n, bool)
        on[far[b[picked]]] = True
        on[root] = False
        if not on.any():
            break
        cycle = picked[on[b[picked]]]
        seen.append((names, live[cycle], b[cycle]))
        instead = np.zeros(n, w.dtype)
        instead[b[cycle]] = w[cycle]
        w, name = w - instead[b], np.where(on, least, np.arange(n))
        names, a, b = name[names], name[a], name[b]
        stays = a != b
        live, a, b, w = live[stays], a[stays], b[stays], w[stays]
    chosen = live[picked]
    for names, cycle, heads in reversed(seen):
        entered = np.zeros(n, bool)
        entered[names[first[chosen]]] = True
        chosen = np.r_[chosen, cycle[~entered[heads]]]
    return chosen


def _finish(root: object, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The chosen ones of all rows (src, dst, weight, a, b, w); none if the root does not reach every end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [x for x in batches if len(x)]
        if not rows:
            return
        arcs = pa.Table.from_batches(rows).sort_by([("src", "ascending"), ("dst", "ascending")]).combine_chunks()
        kind = arcs.schema.field("a").type
        ids = pc.unique(pa.chunked_array([*arcs["a"].chunks, *arcs["b"].chunks, pa.array([root], kind)]))
        at = lambda c: pc.index_in(c, ids).to_numpy(zero_copy_only=False).astype(np.int64)
        found = contracted(len(ids), int(at(pa.array([root], kind))[0]), at(arcs["a"].combine_chunks()), at(arcs["b"].combine_chunks()), arcs["w"].to_numpy())
        if found is not None:
            yield from arcs.select(names).take(pa.array(found)).combine_chunks().to_batches()

    return run


def minimum_arborescence(graph: Graph, root: object, max_rounds: int = 10_000) -> DataFrame:
    """(src, dst, weight) of the arcs of least total weight by which ``root`` reaches every vertex.

    A round takes the cheapest arc into every vertex, ties by (src, dst). Where
    these close cycles, each becomes a vertex, and an arc into it costs what it
    costs more than the arc of the cycle that it would replace. Of the cycles of
    a round, unfolded last to first, every vertex keeps its arc but the one by
    which the cycle is entered. Once at most ``BASE`` arcs are left, one task goes
    through the remaining rounds in arrays. ValueError for undirected graphs, an unknown
    root, or vertices that it does not reach. Null weights count as 1, loops and
    arcs into the root are never taken.
    """
    if not graph.directed:
        raise ValueError("arborescences are defined for directed graphs")
    if graph.vertices.where(F.col("id") == root).isEmpty():
        raise ValueError("the root is no vertex")
    arcs = graph.arcs().where(F.col("src") != F.col("dst")).where(F.col("dst") != root).select("src", "dst", "weight")
    state = save(arcs.select("src", "dst", "weight", F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("w")), "arcs")
    names = save(graph.vertices.select("id").where(F.col("id") != root), "names")
    seen = []
    plain = isinstance(graph.vertices.schema["id"].dataType, (IntegerType, LongType, StringType)) and isinstance(state.schema["w"].dataType, (ByteType, ShortType, IntegerType, LongType, FloatType, DoubleType))
    for _ in range(max_rounds):
        if plain and state.count() <= BASE:
            ship(graph.spark)
            picked = state.select("src", "dst", "weight", "a", "b", "w").coalesce(1).mapInArrow(_finish(root, ["src", "dst", "weight"]), state.select("src", "dst", "weight").schema)
            picked = save(picked, "picked")
            if picked.count() != names.count():
                raise ValueError("no arborescence: the root does not reach every vertex")
            break
        best = state.groupBy("b").agg(F.min(F.struct("w", "src", "dst", "weight", "a")).alias("x"))
        picked = save(best.select("b", "x.*"), "picked")
        n = names.count()
        if picked.count() != n:
            raise ValueError("no arborescence: the root does not reach every vertex")
        cycles = save(_on_cycles(picked.select(F.col("b").alias("id"), F.col("a").alias("to")).where(F.col("a") != root), n), "cycles")
        if cycles.isEmpty():
            break
        of = lambda end: cycles.select(F.col("id").alias(end), F.col("cycle").alias(f"c{end}"))
        seen.append((state, picked.join(of("b"), "b", "left_semi")))
        cost = picked.join(of("b"), "b", "left_semi").select("b", F.col("w").alias("instead"))
        named = state.join(of("a"), "a", "left").join(of("b"), "b", "left").join(cost, "b", "left")
        named = named.select("src", "dst", "weight", F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"), (F.col("w") - F.coalesce("instead", F.lit(0))).alias("w")).where("a <> b")
        names = save(names.join(cycles, "id", "left").select(F.coalesce("cycle", "id").alias("id")).distinct(), "names")
        state = save(named, "arcs")
    else:
        raise RuntimeError(f"cycles are left after {max_rounds} rounds")
    chosen = picked.select("src", "dst", "weight")
    for state, on_cycle in reversed(seen):
        entered = state.join(chosen.select("src", "dst"), ["src", "dst"], "left_semi").select("b")
        chosen = save(chosen.unionByName(on_cycle.join(entered, "b", "left_anti").select("src", "dst", "weight")), "chosen")
    return chosen
