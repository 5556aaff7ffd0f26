"""Searches from many sources at once: a part of the graph and a block of its sources are a task's.

Rounds over a table of all pairs write and shuffle that table again and again.
Here the arcs of a connected part go to one task for each block of its sources,
which searches in arrays and hands on its rows as it finds them, so that only
arcs are shuffled and nothing is as large as all pairs but the answer. Small
parts share a task. Where weights are small whole numbers, a distance's
vertices are bit sets over the block's sources; other weights are relaxed until
nothing changes. A part with more than ``MAX_ARCS`` arcs, or weights that are
negative or not finite, are left to the rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window

from graphloom.graph import Graph
from graphloom.plans import connected_components, save, ship, shuffle_partitions

#: Arcs of a part that one task can hold.
MAX_ARCS = 1 << 22
#: A graph of no more arcs is one part, whatever its components.
ONE = 1 << 14
#: Parts of fewer vertices share tasks of about twice as many.
SMALL = 1 << 10
#: Sources of a block at most.
WIDEST = 1 << 11
#: The largest whole weight that bit sets are kept for.
TALLEST = 64
#: Numbers that a step in arrays holds at once, and rows of a batch.
STEP, BATCH = 1 << 17, 1 << 17


class Runs:
    """Arcs by one of their ends; ends with the most arcs come first."""

    def __init__(self, end: np.ndarray) -> None:
        self.order = np.argsort(end, kind="stable")
        heads, starts, counts = np.unique(end[self.order], return_index=True, return_counts=True)
        by = np.argsort(-counts, kind="stable")
        self.heads, self.starts, self.counts = heads[by], starts[by], counts[by]

    def reduce(self, op: np.ufunc, value: Callable[[np.ndarray], np.ndarray], width: int, keep: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ends, op over value(arcs of each)), a number of ends at a time; value gets places in ``order``; keep: the ends wanted."""
        heads, starts, counts = self.heads, self.starts, self.counts
        if keep is not None:
            wanted = keep[heads]
            heads, starts, counts = heads[wanted], starts[wanted], counts[wanted]
        step = max(1, STEP // width)
        for i in range(0, len(heads), step):
            at, many = starts[i : i + step], counts[i : i + step]
            out = value(at)
            for j in range(1, min(int(many[0]), 64)):
                k = int(np.searchsorted(-many, -j))
                op(out[:k], value(at[:k] + j), out=out[:k])
            for r in range(int(np.searchsorted(-many, -64))):
                for j in range(64, int(many[r]), step):
                    op(out[r], op.reduce(value(np.arange(at[r] + j, at[r] + min(j + step, int(many[r])))), axis=0), out=out[r])
            yield heads[i : i + step], out


def by_levels(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, sources: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
    """(distance, for each vertex the set of sources at that distance, in words of 64 bits), nearest first; weights are whole and positive."""
    words = -(-len(sources) // 64)
    weights = [(int(x), (at := np.flatnonzero(w == x)), Runs(b[at])) for x in np.unique(w)]
    weights = [(x, a[at][runs.order], runs) for x, at, runs in weights]
    first, full = np.zeros((n, words), np.uint64), np.zeros(words, np.uint64)
    i = np.arange(len(sources))
    first[sources, i >> 6] = np.left_shift(np.uint64(1), (i & 63).astype(np.uint64))
    np.bitwise_or.at(full, i >> 6, np.left_shift(np.uint64(1), (i & 63).astype(np.uint64)))
    seen, near, dist = first.copy(), {0: first}, 0
    yield 0.0, first
    while near:
        dist += 1
        open_, new = (seen != full).any(axis=1), np.zeros((n, words), np.uint64)
        for x, tails, runs in weights:
            if (front := near.get(dist - x)) is not None:
                for heads, found in runs.reduce(np.bitwise_or, lambda k, front=front, tails=tails: front[tails[k]], words, open_):
                    new[heads] |= found
        near.pop(dist - weights[-1][0], None)
        new &= ~seen
        if new.any():
            seen |= new
            near[dist] = new
            yield float(dist), new


def relaxed(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """Distances (vertex, source) along arcs of weights of 0 and more, infinite where there is no path."""
    dist, runs = np.full((n, len(sources)), np.inf), Runs(b)
    dist[sources, np.arange(len(sources))] = 0.0
    tails, cost = a[runs.order], w[runs.order, None]
    moved = True
    while moved:
        moved, old = False, dist.copy()
        for heads, found in runs.reduce(np.minimum, lambda k: old[tails[k]] + cost[k], len(sources)):
            better = found < dist[heads]
            if better.any():
                moved, dist[heads] = True, np.minimum(found, dist[heads])
    return dist


def _whole(w: np.ndarray) -> bool:
    return len(w) > 0 and w.min() >= 1 and w.max() <= TALLEST and bool((w == np.floor(w)).all())


def _sub_blocks(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, sources: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(sources, distances (vertex, source)) of so many sources at a time."""
    for i in range(0, len(sources), most):
        some = sources[i : i + most]
        if _whole(w):
            dist = np.full((n, len(some)), np.inf)
            for far, sets in by_levels(n, a, b, w, some):
                dist[np.unpackbits(sets.view(np.uint8), axis=1, count=len(some), bitorder="little").view(bool)] = far
        else:
            dist = relaxed(n, a, b, w, some)
        yield some, dist


def _levels(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, sources: np.ndarray) -> Iterator[tuple[np.ndarray, float, np.ndarray]]:
    """(sources, distance, bit sets over the sources), a distance at a time; or (sources, nan, distances by vertex and source)."""
    if _whole(w):
        yield from ((sources, far, sets) for far, sets in by_levels(n, a, b, w, sources))
        return
    for some, dist in _sub_blocks(n, a, b, w, sources, max(1, min(64, (1 << 22) // n))):
        found = np.unique(dist[np.isfinite(dist)])
        if len(found) > 256:  # too many distances for a pass each
            yield some, np.nan, dist
            continue
        yield from ((some, float(far), _packed(dist == far)) for far in found)


def _packed(at: np.ndarray) -> np.ndarray:
    sets = np.packbits(at, axis=1, bitorder="little")
    return np.pad(sets, ((0, 0), (0, -sets.shape[1] % 8))).view(np.uint64)


def _pairs(sets: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(vertices, places of sources) of the members of bit sets."""
    step = max(1, (BATCH * 8) // (64 * sets.shape[1]))
    for i in range(0, len(sets), step):
        v, s = np.nonzero(np.unpackbits(sets[i : i + step].view(np.uint8), axis=1, count=k, bitorder="little"))
        for j in range(0, len(v), BATCH):
            yield v[j : j + BATCH] + i, s[j : j + BATCH]


def _members(sets: np.ndarray, k: int) -> np.ndarray:
    """How many vertices each of k sources has in bit sets."""
    out = np.zeros(k, np.int64)
    step = 255 * max(1, STEP // (255 * sets.shape[1]))
    for i in range(0, len(sets), step):
        bits = np.unpackbits(sets[i : i + step].view(np.uint8), axis=1, count=k, bitorder="little")
        even = len(bits) // 255 * 255
        out += bits[:even].reshape(-1, 255, k).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[even:].sum(axis=0, dtype=np.int64)
    return out


def pairs(ids: pa.Array, a: np.ndarray, b: np.ndarray, w: np.ndarray, sources: np.ndarray) -> Iterator[list]:
    """Rows (source, id, dist)."""
    for some, far, sets in _levels(len(ids), a, b, w, sources):
        names = ids.take(pa.array(some))
        if np.isnan(far):
            for i in range(0, len(sets), step := max(1, BATCH // len(some))):
                v, s = np.nonzero(np.isfinite(sets[i : i + step]))
                yield [names.take(pa.array(s)), ids.take(pa.array(v + i)), sets[v + i, s]]
            continue
        for v, s in _pairs(sets, len(some)):
            yield [names.take(pa.array(s)), ids.take(pa.array(v)), np.full(len(v), far)]


def by_source(ids: pa.Array, a: np.ndarray, b: np.ndarray, w: np.ndarray, sources: np.ndarray) -> Iterator[list]:
    """Rows (source, dist, n): so many vertices at a distance from a source."""
    for some, far, sets in _levels(len(ids), a, b, w, sources):
        if np.isnan(far):
            for s in range(len(some)):
                dist, n = np.unique(sets[np.isfinite(sets[:, s]), s], return_counts=True)
                yield [ids.take(pa.array(np.full(len(n), some[s]))), dist, n]
            continue
        n = _members(sets, len(some))
        yield [ids.take(pa.array(some[n > 0])), np.full(int((n > 0).sum()), far), n[n > 0]]


def by_id(ids: pa.Array, a: np.ndarray, b: np.ndarray, w: np.ndarray, sources: np.ndarray) -> Iterator[list]:
    """Rows (id, dist, n): so many of the sources at a distance from a vertex."""
    for _, far, sets in _levels(len(ids), a, b, w, sources):
        if np.isnan(far):
            v, s = np.nonzero(np.isfinite(sets))
            yield [ids.take(pa.array(v)), sets[v, s], np.ones(len(v), np.int64)]
            continue
        n = np.bitwise_count(sets).sum(axis=1, dtype=np.int64)
        at = np.flatnonzero(n)
        yield [ids.take(pa.array(at)), np.full(len(at), far), n[at]]


def _dependencies(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, sources: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(sources, reached, 1 and each source's dependency on a vertex, shares of the arcs), by vertex or arc and source."""
    width = max(1, min(64, (1 << 22) // max(1, len(a))))
    into, out = Runs(b), Runs(a)
    tails, heads_out = a[into.order], b[out.order]
    for some, far in _sub_blocks(n, a, b, w, sources, 64):
        for i in range(0, len(some), width):
            own, dist = some[i : i + width], far[:, i : i + width]
            k = np.arange(len(own))
            with np.errstate(invalid="ignore"):
                ends = dist[b]
                tight = np.abs(dist[a] + w[:, None] - ends) <= 1e-9 * np.maximum(1.0, np.abs(ends))
            x = np.zeros((n, len(own)))
            x[own, k] = 1.0
            sigma, along = x.copy(), tight[into.order]
            while x.any():
                new = np.zeros_like(x)
                for heads, found in into.reduce(np.add, lambda j, x=x, along=along: x[tails[j]] * along[j], len(own)):
                    new[heads] = found
                x = new
                sigma += x
            reached = sigma > 0
            share = np.where(tight, sigma[a] / np.where(reached, sigma, 1.0)[b], 0.0)
            x, back = reached.astype(np.float64), share[out.order]
            total = np.zeros_like(x)
            while x.any():
                total += x
                new = np.zeros_like(x)
                for heads, found in out.reduce(np.add, lambda j, x=x, back=back: x[heads_out[j]] * back[j], len(own)):
                    new[heads] = found
                x = new
            yield own, reached, total, share


def vertex_scores(ids: pa.Array, a: np.ndarray, b: np.ndarray, w: np.ndarray, sources: np.ndarray) -> Iterator[list]:
    """Rows (id, score): dependencies of the sources on a vertex, their own left out."""
    score = np.zeros(len(ids))
    for own, reached, total, _ in _dependencies(len(ids), a, b, w, sources):
        on = np.where(reached, total - 1.0, 0.0)
        on[own, np.arange(len(own))] = 0.0
        score += on.sum(axis=1)
    yield [ids, score]


def arc_scores(ids: pa.Array, a: np.ndarray, b: np.ndarray, w: np.ndarray, sources: np.ndarray) -> Iterator[list]:
    """Rows (src, dst, score): shares of the sources' shortest paths along an arc."""
    score = np.zeros(len(a))
    for _, _, total, share in _dependencies(len(ids), a, b, w, sources):
        score += (share * total[b]).sum(axis=1)
    at = np.flatnonzero(score)
    yield [ids.take(pa.array(a[at])), ids.take(pa.array(b[at])), score[at]]


def _task(search: Callable, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (task, a, b, w, id), a task's together: arcs between numbers, or a vertex's number with b of -1, -2 if it is a source."""

    def run(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, w = (np.concatenate([x.column(c).to_numpy(zero_copy_only=False) for x in held]) for c in ("a", "b", "w"))
        ids = pa.concat_arrays([x.column("id").filter(pa.array(x.column("b").to_numpy() < 0)) for x in held])
        arc, order = b >= 0, np.argsort(a[b < 0])
        sources = np.sort(a[b == -2])
        for columns in search(ids.take(pa.array(order)), a[arc], b[arc], w[arc], sources):
            for i in range(0, len(columns[0]), BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + BATCH]) if isinstance(c, np.ndarray) else c.slice(i, BATCH) for c in columns], schema=schema)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            task = batch.column("task").to_numpy()
            cuts = [0, *(np.flatnonzero(task[1:] != task[:-1]) + 1).tolist(), len(task)]
            for i, j in zip(cuts, cuts[1:]):
                if i < j:
                    if held and task[i] != at:
                        yield from run(held)
                        held = []
                    at = task[i]
                    held.append(batch.slice(i, j - i))
        if held:
            yield from run(held)

    return tasks


def search(graph: Graph, arcs: DataFrame, sources: DataFrame, kind: str, rest: Callable[[Graph, DataFrame], DataFrame], least: float = 0.0) -> DataFrame:
    """The rows of ``kind`` (pairs, by_source, by_id, vertex_scores or arc_scores) along ``arcs`` (src, dst, weight) from all ``sources`` (id).

    Sources need not be vertices. ``rest`` does the same for graphs that a task
    cannot hold or whose weights are not above (scores) or at least 0. Rows of
    by_id and of the scores come once for each block and are to be summed.
    """
    spark, kinds = graph.spark, {f.__name__: f for f in (pairs, by_source, by_id, vertex_scores, arc_scores)}
    arcs = save(arcs.select("src", "dst", F.col("weight").cast("double").alias("weight")), "arcs")
    sources = save(sources.select("id").distinct(), "sources")
    w = F.col("weight")
    scores = kind.endswith("scores")
    odd = arcs.where(w.isNull() | F.isnan(w) | (w == float("inf")) | ((w <= 0) if scores else (w < 0)))
    if not odd.isEmpty():
        return rest(Graph(graph.vertices, arcs, True), sources)
    arcs = arcs.where("src <> dst")
    if arcs.count() <= ONE:
        comps = save(arcs.select(F.col("src").alias("id")).unionByName(arcs.select(F.col("dst").alias("id"))).distinct().withColumn("component", F.lit(0)), "parts")
    else:
        comps = save(connected_components(arcs), "parts")
    sizes = comps.groupBy("component").agg(F.count(F.lit(1)).alias("n")).join(arcs.join(comps.withColumnRenamed("id", "src"), "src").groupBy("component").agg(F.count(F.lit(1)).alias("m")), "component")
    sizes = save(sizes, "sizes")
    found = sizes.agg(F.sum(F.when(F.col("n") < SMALL, F.col("n"))).alias("small"), F.max("m").alias("most")).first()
    bins = max(1, (found["small"] or 0) // (2 * SMALL))
    key = F.xxhash64("component")
    place = F.when(F.col("n") < SMALL, F.pmod(key, F.lit(bins))).otherwise(key).alias("place")
    held = comps.join(sizes.where(F.col("m") <= MAX_ARCS).select("component", place), "component").join(sources.withColumn("own", F.lit(1)), "id", "left")
    by = Window.partitionBy("place").orderBy("id")  # no more rows than a task holds arcs
    numbered = save(held.select("place", "id", (F.row_number().over(by) - 1).alias("a"), F.col("own").isNotNull().alias("own"), (F.sum(F.coalesce("own", F.lit(0))).over(by) - 1).alias("r")), "numbered")
    n = numbered.where("own").count()
    cores = max(spark.sparkContext.defaultParallelism, 1)
    width = int(min(WIDEST, max(64, -(-n // (4 * cores) // 64) * 64)))
    blocks = numbered.where("own").groupBy("place").agg((F.floor(F.max("r") / width) + 1).cast("int").alias("k"))
    blocks = save(blocks.withColumn("first", F.sum("k").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1))).na.fill(0, ["first"]), "blocks")  # a row for a thousand vertices
    tasks = blocks.agg(F.sum("k")).first()[0] or 0
    out = None
    id_type = graph.vertices.schema["id"].dataType
    ends = {"pairs": ["source", "id"], "by_source": ["source"], "by_id": ["id"], "vertex_scores": ["id"], "arc_scores": ["src", "dst"]}[kind]
    fields = [StructField(c, id_type) for c in ends] + [StructField("score" if scores else "dist", DoubleType())] + ([StructField("n", LongType())] if kind.startswith("by_") else [])
    if tasks:
        ship(spark)
        at = lambda end, c: numbered.select(F.col("id").alias(end), "place", F.col("a").alias(c))
        links = arcs.join(at("src", "a"), "src").join(at("dst", "b").drop("place"), "dst").select("place", "a", "b", "weight", F.lit(None).cast(id_type).alias("id"), F.lit(-1).alias("r"))
        marks = numbered.select("place", "a", F.when(F.col("own"), F.col("r")).otherwise(-1).cast("int").alias("r"), "id")
        marks = marks.select("place", "a", F.lit(-1).alias("b"), F.lit(0.0).alias("weight"), "id", "r")
        rows = links.unionByName(marks).join(F.broadcast(blocks), "place").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        mine = (F.col("b") < 0) & (F.col("r") >= 0) & (F.floor(F.col("r") / width) == F.col("block"))
        rows = rows.select((F.col("first") + F.col("block")).cast("long").alias("task"), "a", F.when(mine, -2).otherwise(F.col("b")).alias("b"), F.col("weight").alias("w"), "id")
        parts = min(int(tasks), max(shuffle_partitions(spark), 4096))
        rows = rows.repartitionById(parts, (F.col("task") % parts).cast("int"))
        rows = rows if parts == tasks else rows.sortWithinPartitions("task")
        out = rows.mapInArrow(_task(kinds[kind], to_arrow(fields)), StructType(fields))
    if not scores:
        alone = sources.join(comps, "id", "left_anti")
        zero = alone.select(*(F.col("id").alias(c) for c in ends), F.lit(0.0).alias("dist"), *([F.lit(1).cast("long").alias("n")] if kind.startswith("by_") else []))
        out = zero if out is None else out.unionByName(zero)
    if (found["most"] or 0) > MAX_ARCS:
        large = save(comps.join(sizes.where(F.col("m") > MAX_ARCS), "component", "left_semi").select("id"), "large")
        inside = arcs.join(large.withColumnRenamed("id", "src"), "src", "left_semi")
        more = rest(Graph(large, inside, True), sources.join(large, "id", "left_semi"))
        out = more if out is None else out.unionByName(more)
    return spark.createDataFrame([], StructType(fields)) if out is None else out


def to_arrow(fields: list[StructField]) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType(fields))
