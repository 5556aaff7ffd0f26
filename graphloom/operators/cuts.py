"""The least cut of a whole undirected graph: safe contractions first, random contractions of what is left."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType
from pyspark.sql.window import Window

from graphloom.graph import Graph
from graphloom.operators.connectivity import weak_components
from graphloom.operators.structure import spanning_forest
from graphloom.plans import connected_components, running_total, save, ship

#: Vertices of a contracted graph that one task finishes exactly.
BASE = 64
#: Edges that one task cuts exactly, by scans.
HELD = 1 << 21


def _shared_weight(edges: DataFrame) -> DataFrame:
    """(a, b, common): for each edge the sum over common neighbours x of min(w(a, x), w(b, x)).

    Every triangle is made once, from its end of least degree, so a hub starts none of its own.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy("a").agg(F.count(F.lit(1)).alias("d"))
    rank = lambda end: degree.select(F.col("a").alias(end), F.struct("d", "a").alias(f"r{end}"))
    ranked = edges.join(rank("a"), "a").join(rank("b"), "b")
    up = F.col("ra") < F.col("rb")
    out = save(ranked.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("y"), "w"), "oriented")
    xy, xz, yz = out, out.select("x", F.col("y").alias("z"), F.col("w").alias("w2")), out.select(F.col("x").alias("y"), F.col("y").alias("z"), F.col("w").alias("w3"))
    wedge = xy.join(xz, "x")
    found = wedge.join(yz, ["y", "z"])
    side = lambda p, q, u, v: F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b"), F.least(u, v).alias("common"))
    each = found.select(F.explode(F.array(side("x", "y", "w2", "w3"), side("x", "z", "w", "w3"), side("y", "z", "w", "w2"))).alias("s"))
    return each.select("s.*").groupBy("a", "b").agg(F.sum("common").alias("common"))


def _moved(edges: DataFrame, to: DataFrame, keys: list[str]) -> DataFrame:
    """Edges with their ends renamed by ``to`` (keys, id, component), without loops, parallel ones summed."""
    name = lambda end: to.select(*keys, F.col("id").alias(end), F.col("component").alias(f"n{end}"))
    ends = edges.join(name("a"), [*keys, "a"], "left").join(name("b"), [*keys, "b"], "left").select(*keys, F.coalesce("na", "a").alias("a"), F.coalesce("nb", "b").alias("b"), "w")
    return ends.where("a <> b").groupBy(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").alias("w"))


def _least_cut(rows: pd.DataFrame) -> pd.DataFrame:
    """Stoer and Wagner's maximum adjacency orders over at most BASE vertices: (run, value, members of one side)."""
    names = np.unique(rows[["a", "b"]].to_numpy())
    at = {v: i for i, v in enumerate(names)}
    w = np.zeros((len(names), len(names)))
    for a, b, x in zip(rows["a"].map(at), rows["b"].map(at), rows["w"], strict=True):
        w[a, b] += x
        w[b, a] += x
    groups, live = [[v] for v in names.tolist()], list(range(len(names)))
    best, side = math.inf, []
    while len(live) > 1:
        weight, order = w[live[0]].copy(), [live[0]]
        while len(order) < len(live):
            rest = [v for v in live if v not in order]
            v = rest[int(np.argmax(weight[rest]))]
            value = float(weight[v])
            weight += w[v]
            order.append(v)
        s, t = order[-2:]
        if value < best:
            best, side = value, list(groups[t])
        groups[s] += groups[t]
        w[s] += w[t]
        w[:, s] += w[:, t]
        w[s, s] = 0.0
        live.remove(t)
    return pd.DataFrame({"run": [int(rows["run"].iloc[0])], "value": [best], "members": [side]})


def scanned_cut(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """(value, whether a vertex is on one side) of a least cut of a connected graph of n vertices, by Nagamochi, Ono and Ibaraki's scans.

    A scan takes the vertices by their weight to those taken before, at most the
    best cut's. An edge whose later end weighs that much with it cannot be parted
    by a better cut and is contracted; the last vertex taken always has one.
    """
    names, best, side = np.arange(n), math.inf, np.zeros(n, bool)
    while n > 1:
        tails, heads, cost = np.r_[a, b], np.r_[b, a], np.r_[w, w]
        order = np.argsort(tails, kind="stable")
        tails, heads, cost = tails[order], heads[order], cost[order]
        ends = np.searchsorted(tails, np.arange(n + 1))
        degree = np.bincount(tails, cost, n)
        if degree.min() < best:
            best = float(degree.min())
            side = names == int(degree.argmin())
        near, done, root, cut, taken = np.zeros(n), np.zeros(n, bool), list(range(n)), 0.0, []
        queue, shortest, most = [(0.0, 0)], (math.inf, 0), best

        def find(v: int, root: list[int] = root) -> int:
            while root[v] != v:
                root[v] = root[root[v]]
                v = root[v]
            return v

        while queue:
            v = heapq.heappop(queue)[1]
            if done[v]:
                continue
            done[v] = True
            taken.append(v)
            cut += degree[v] - 2 * near[v]
            if len(taken) < n and cut < shortest[0]:
                shortest = (cut, len(taken))
            to, x = heads[ends[v] : ends[v + 1]], cost[ends[v] : ends[v + 1]]
            open_ = ~done[to]
            to, before = to[open_], near[to[open_]]
            near[to] = now = before + x[open_]
            for u in to[now >= most].tolist():
                root[find(u)] = find(v)
            rises = before < most
            for u, y in zip(to[rises].tolist(), np.minimum(now[rises], most).tolist()):
                heapq.heappush(queue, (-y, u))
        if shortest[0] < best:
            best = float(shortest[0])
            side = np.isin(names, taken[: shortest[1]])
        _, label = np.unique([find(v) for v in range(n)], return_inverse=True)
        names, n = label[names], int(label.max()) + 1
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low != high
        key, at = np.unique(low[apart] * n + high[apart], return_inverse=True)
        a, b, w = key // n, key % n, np.bincount(at, w[apart], len(key))
    return best, side


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows (a, b, w): (value, id) of one side of a least cut."""
    rows = [x for x in batches if len(x)]
    if rows:
        edges = pa.Table.from_batches(rows).sort_by([("a", "ascending"), ("b", "ascending")]).combine_chunks()
        ids = pc.unique(pa.chunked_array([*edges["a"].chunks, *edges["b"].chunks]))
        at = lambda c: pc.index_in(edges[c].combine_chunks(), ids).to_numpy(zero_copy_only=False).astype(np.int64)
        value, side = scanned_cut(len(ids), at("a"), at("b"), edges["w"].to_numpy())
        chosen = ids.take(pa.array(np.flatnonzero(side)))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(chosen), value)), chosen], ["value", "id"])


def _contracted(edges: DataFrame, k: int, to: int, width: int, seed: int) -> DataFrame:
    """(run, id, component) after random contraction of every run's graph of k vertices to ``to``.

    An edge comes after a waiting time of rate w, and the first k - ``to`` edges
    that join something are contracted; these are the first edges of the
    spanning tree of least waiting times. All runs share one plan: a vertex of
    a run is numbered run * ``width`` + id.
    """
    u = (F.pmod(F.xxhash64(F.lit(seed), "run", "a", "b"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    wait = edges.select((F.col("run") * width + F.col("a")).alias("src"), (F.col("run") * width + F.col("b")).alias("dst"), (-F.log(u) / F.col("w")).alias("weight"))
    tree = spanning_forest(Graph(wait.select(F.col("src").alias("id")).unionByName(wait.select(F.col("dst").alias("id"))).distinct(), wait, False))
    by = Window.partitionBy("run").orderBy("weight", "src", "dst")
    first = tree.withColumn("run", F.floor(F.col("src") / width)).withColumn("k", F.row_number().over(by)).where(F.col("k") <= k - to)
    both = connected_components(first.select("src", "dst"))
    return both.select(F.floor(F.col("id") / width).alias("run"), (F.col("id") % width).alias("id"), (F.col("component") % width).alias("component"))


def _kernel_cut(edges: DataFrame, seed: int, base: int) -> tuple[float, DataFrame]:
    """(value, ids of one side) of the least cut of edges (a, b, w).

    Up to ``HELD`` edges or ``base`` vertices it is exact. Beyond, Karger and Stein's recursion runs
    level by level: each run contracts to about k / sqrt(2) vertices and goes on
    twice. log2(k)^2 first runs miss a least cut with a chance of about 1 / k.
    """
    if isinstance(edges.schema["a"].dataType, (IntegerType, LongType, StringType)) and edges.count() <= HELD:
        ship(edges.sparkSession)
        rows = edges.select("a", "b", F.col("w").cast("double").alias("w")).coalesce(1)
        side = save(rows.mapInArrow(_scan, f"value double, id {edges.schema['a'].dataType.simpleString()}"), "side")
        return side.first()["value"], side.select("id")
    ends = save(edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).distinct().withColumn("g", F.lit(0)), "kernel")
    number = save(running_total(ends, ["g"], [F.col("id")], F.lit(1).cast("long"), "n").select("id", "n"), "kernel")
    k = width = number.count()
    to = lambda end: number.select(F.col("id").alias(end), F.col("n").alias(f"n{end}"))
    one = edges.join(to("a"), "a").join(to("b"), "b").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"), F.col("w").cast("double").alias("w"))
    first = 1 if k <= base else math.ceil(math.log2(k)) ** 2
    runs = edges.sparkSession.range(first).withColumnRenamed("id", "run")
    rows = save(one.crossJoin(runs).select("run", "a", "b", "w"), "runs")  # a copy of the graph for each run
    names = save(number.select("n").crossJoin(runs).select("run", "n", F.col("n").alias("at")), "names") if k > base else None
    while k > base:
        k, old = max(base, math.ceil(1 + k / math.sqrt(2))), k
        comps = save(_contracted(rows, old, k, width, seed), "contracted")
        twice = F.explode(F.array(F.col("run") * 2, F.col("run") * 2 + 1)).alias("run")
        on = comps.select("run", F.col("id").alias("at"), "component")
        rows, seed = save(_moved(rows, comps, ["run"]).select(twice, "a", "b", "w"), "runs"), seed + 1
        names = save(names.join(on, ["run", "at"], "left").select(twice, "n", F.coalesce("component", "at").alias("at")), "names")
    cuts = save(rows.groupBy("run").applyInPandas(_least_cut, "run long, value double, members array<long>"), "cuts")
    best = cuts.orderBy("value", "run").first()  # members: at most ``base``
    side = number if names is None else number.join(names.where(F.col("run") == best["run"]).select("n", "at"), "n")
    return best["value"], side.where(F.col("n" if names is None else "at").isin(best["members"])).select("id")


def global_min_cut(graph: Graph, seed: int = 0, base: int = BASE) -> DataFrame:
    """(id, source_side): the two sides of a cut of least weight; ValueError for directed graphs.

    Edges whose ends no cut below the best one known can part are contracted,
    all at once and until there are none: those that weigh as much with what
    their ends share with common neighbours. The best cut known is that of a
    single vertex of some round. Once at most ``HELD`` edges are left, one task
    cuts them exactly by scans; other kinds of ids are cut exactly up to ``base``
    vertices, else by random contractions that miss a least cut with a chance of
    about 1 in its vertices. Weights of 0 and less and loops are no edges; null
    counts as 1. A graph in several pieces has a cut of weight 0, around the
    piece of the smallest id; graphs of one vertex or none have one side.
    """
    if graph.directed:
        raise ValueError("global cuts are defined for undirected graphs")
    edges = graph.edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.coalesce("weight", F.lit(1)).alias("w")).where("w > 0")
    edges = save(edges.groupBy("a", "b").agg(F.sum("w").alias("w")), "edges")
    pieces = save(weak_components(Graph(graph.vertices.select("id"), edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("w").alias("weight")), False)), "pieces")
    ends = pieces.agg(F.min("component").alias("least"), F.max("component").alias("most")).first()
    if ends["least"] != ends["most"] or edges.isEmpty():
        return pieces.select("id", (F.col("component") == ends["least"]).alias("source_side"))
    at, value, side = pieces.select("id", F.col("id").alias("at")), None, None
    plain = isinstance(edges.schema["a"].dataType, (IntegerType, LongType, StringType))
    while not (plain and edges.count() <= HELD):
        degree = edges.select("a", "w").unionByName(edges.select(F.col("b").alias("a"), "w")).groupBy("a").agg(F.sum("w").alias("d"))
        alone = degree.orderBy("d", "a").first()
        if value is None or alone["d"] < value:
            value, side = alone["d"], at.where(F.col("at") == alone["a"]).select("id")
        tied = edges.join(_shared_weight(edges), ["a", "b"], "left").where(F.col("w") + F.coalesce("common", F.lit(0)) >= value)
        tied = save(tied.select("a", "b"), "tied")
        if tied.isEmpty():
            break
        comps = save(connected_components(tied, "a", "b"), "merged")
        at = save(at.join(comps.select(F.col("id").alias("at"), "component"), "at", "left").select("id", F.coalesce("component", "at").alias("at")), "at")
        edges = save(_moved(edges, comps, []), "edges")
        if edges.isEmpty():
            break
    if not edges.isEmpty():
        least, ids = _kernel_cut(edges, seed, base)
        if value is None or least < value:
            side = at.join(ids.select(F.col("id").alias("at")), "at", "left_semi").select("id")
    return pieces.select("id").join(side.select("id", F.lit(True).alias("source_side")), "id", "left").na.fill(False, ["source_side"])
