"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors of cosine c are sqrt(2 - 2c) apart. All are turned by one
rotation and split into low-dimensional blocks; if two are within the squared
distance D, then in some block they are within that block's proportional share
of D. So each block is joined by range on its own:

* the rotation deals the main axes of a bounded sample over the blocks, so
  that each block has as much spread as the others, on few coordinates;
* a k-d tree over several coordinates of the block, cut from the same sample,
  gives leaves; a vector is at home in one leaf and a guest in those leaves
  whose box its ball (the block's share of D) reaches. Of two leaves only one
  takes the other's guests, so every pair within the share meets once;
* a leaf's vectors are dealt over tiles of bounded size, and a task compares
  one tile with itself and with some others. Squares of vectors whose boxes
  are too far apart are passed over.

Every row goes through the index; the sample only places its cuts. A pair
belongs to the first block that brings it together, so the union of the
blocks' candidates needs no list of pairs: tasks count a vector's links and
keep a spanning forest of them. Candidates are verified by their cosine in
double precision. Equal vectors are one row with a count all along.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.batches import map_batches
from graphloom.llm.vectors import by_dimension
from graphloom.plans import connected_components, save

BLOCK_DIMS = 16
#: Numbers that the vectors of a tile hold, tiles that a task compares one tile with, and the side of the squares that are compared at a time.
TILE_VALUES, OTHERS, SQUARE = 1 << 20, 6, 512
#: Vectors of each dimension that place the cuts, and leaves of a block at most; fuller leaves have more tiles.
SAMPLE, MOST_LEAVES = 8192, 1024
SLACK = 1e-5


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, whatever their magnitude; rows must not be zero."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def blocks_of(dims: int, block_dims: int = BLOCK_DIMS) -> list[slice]:
    n = max(1, dims // block_dims)
    cuts = np.linspace(0, dims, n + 1).astype(int)
    return [slice(int(a), int(b)) for a, b in zip(cuts, cuts[1:], strict=False)]


def rotation(sample: np.ndarray, parts: list[slice]) -> np.ndarray:
    """Orthogonal columns: the main axes of a sample of unit vectors, dealt over the blocks by falling spread."""
    dims = sample.shape[1]
    _, axes = np.linalg.eigh(sample.T @ sample + 1e-9 * np.eye(dims))
    room = [p.stop - p.start for p in parts]
    dealt: list[list[int]] = [[] for _ in parts]
    turn = [*range(len(parts)), *reversed(range(len(parts)))]
    at = 0
    for axis in range(dims - 1, -1, -1):
        while len(dealt[turn[at % len(turn)]]) == room[turn[at % len(turn)]]:
            at += 1
        dealt[turn[at % len(turn)]].append(axis)
        at += 1
    return np.ascontiguousarray(axes[:, [i for part in dealt for i in part]])


def turned(x: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Unit vectors in the turned frame; a row comes out the same in any batch."""
    return np.einsum("ij,jk->ik", unit(x), turn).astype(np.float32)


class Tree:
    """k-d tree over the coordinates of a block: leaves of about equal load, none cut along a side that a ball spans anyway."""

    def __init__(self, sample: np.ndarray, leaves: int, radius: float) -> None:
        self.nodes: list[tuple[int, float, int, int]] = []  # axis (-1: a leaf), cut, and the children or the leaf's number
        self.n = 0
        self._grow(sample.astype(np.float64), leaves, radius)

    def _grow(self, x: np.ndarray, leaves: int, radius: float) -> int:
        me = len(self.nodes)
        self.nodes.append((-1, 0.0, self.n, 0))
        axis = int(x.var(axis=0).argmax()) if len(x) > 1 else 0
        cut = float(np.median(x[:, axis])) if len(x) else 0.0
        low = x[:, axis] < cut if len(x) else np.zeros(0, dtype=bool)
        if leaves < 2 or len(x) < 16 or not low.any() or low.all() or np.ptp(x[:, axis]) <= 2 * radius:
            self.n += 1
            return me
        left = self._grow(x[low], (leaves + 1) // 2, radius)
        right = self._grow(x[~low], leaves // 2, radius)
        self.nodes[me] = (axis, cut, left, right)
        return me

    def home(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            axis, cut, a, b = self.nodes[node]
            if axis < 0:
                out[at] = a
            else:
                low = x[at, axis] < cut
                todo += [(a, at[low]), (b, at[~low])]
        return out

    def reached(self, x: np.ndarray, budget: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves whose box is within the squared distance ``budget``."""
        rows, leaves = [], []
        todo = [(0, np.arange(len(x)), np.zeros(x.shape))]
        while todo:
            node, at, gaps = todo.pop()
            axis, cut, a, b = self.nodes[node]
            if not len(at):
                continue
            if axis < 0:
                rows.append(at)
                leaves.append(np.full(len(at), a))
                continue
            off = x[at, axis].astype(np.float64) - cut
            for child, wrong in ((a, off >= 0), (b, off < 0)):
                there = gaps.copy()
                there[:, axis] = np.where(wrong, np.maximum(there[:, axis], np.abs(off)), there[:, axis])
                near = (there * there).sum(axis=1) <= budget
                todo.append((child, at[near], there[near]))
        return np.concatenate(rows) if rows else np.zeros(0, np.int64), np.concatenate(leaves) if leaves else np.zeros(0, np.int64)


@dataclass
class Frame:
    """How vectors of one dimension are turned, split into blocks with their squared distances, and cut into leaves."""

    parts: list[slice]
    budget: list[float]
    turn: np.ndarray
    trees: list[Tree]


def framed(sample: np.ndarray, n: int, reach: float, block_dims: int, tile: int) -> Frame:
    """From a sample of the n vectors of a dimension."""
    dims = sample.shape[1]
    parts = blocks_of(dims, block_dims)
    budget = [reach * (p.stop - p.start) / dims + SLACK for p in parts]
    turn = rotation(unit(sample), parts)
    u = turned(sample, turn)
    return Frame(parts, budget, turn, [Tree(u[:, p], min(MOST_LEAVES, -(-n // tile)), math.sqrt(b)) for p, b in zip(parts, budget, strict=True)])


def takes(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether leaf ``one`` takes guests from leaf ``other``; each of two leaves does for about half of its partners."""
    return (one < other) == ((one + other) % 2 == 1)


def _checked(vectors: DataFrame, kept: str) -> DataFrame:
    """id, dims, print and raw (the vector; doubles scaled by a power of two so that their squares are in range) of those that can link."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            out = []
            for rows, x in by_dimension(batch.column(1)):
                most = np.abs(x).max(axis=1)
                rows, x, most = rows[most > 0], x[most > 0], most[most > 0]
                raw = x.astype("<f4") if kept == "<f4" else np.ldexp(x, -np.frexp(most)[1][:, None]).astype("<f8")
                data = [v.tobytes() for v in raw]
                out.append(pa.record_batch([batch.column(0).take(pa.array(rows)), pa.array(np.full(len(rows), x.shape[1], np.int32)), pa.array(list(map(xxhash.xxh3_128_digest, data)), pa.binary()), pa.array(data, pa.binary())], ["id", "dims", "print", "raw"]))
            return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if out and sum(x.num_rows for x in out) else None

        return each

    return map_batches(vectors, make, "id long, dims int, print binary, raw binary")


def _matrix(raw: list[bytes], kept: str, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), dtype=kept).reshape(-1, dims).astype(np.float64)


def _placed(classes: DataFrame, frames: dict[int, Frame], kept: str) -> DataFrame:
    """Classes with ``places``: block, leaf and side (0 at home, 1 guest)."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            dims, raw = batch["dims"].to_numpy(), batch["raw"].to_pylist()
            places: list[list[dict]] = [[] for _ in raw]
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                frame = frames[int(d)]
                u = turned(_matrix([raw[i] for i in at], kept, int(d)), frame.turn)
                for b, (part, tree) in enumerate(zip(frame.parts, frame.trees, strict=True)):
                    home = tree.home(u[:, part])
                    row, leaf = tree.reached(u[:, part], frame.budget[b] + SLACK)
                    own = home[row]
                    guest = (leaf != own) & takes(leaf, own)
                    for i, h in zip(at.tolist(), home.tolist(), strict=True):
                        places[i].append({"block": b, "leaf": h, "side": 0})
                    for i, h in zip(at[row[guest]].tolist(), leaf[guest].tolist(), strict=True):
                        places[i].append({"block": b, "leaf": h, "side": 1})
            kind = pa.list_(pa.struct([("block", pa.int32()), ("leaf", pa.int32()), ("side", pa.int32())]))
            return pa.record_batch([*(batch[c] for c in ("id", "dims", "n", "raw")), pa.array(places, kind)], ["id", "dims", "n", "raw", "places"])

        return each

    return map_batches(classes.select("id", "dims", "n", "raw"), make, "id long, dims int, n long, raw binary, places array<struct<block int, leaf int, side int>>")


def _forest(lab: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Join labels along pairs; the pairs that joined two trees."""
    kept = []
    while True:
        la, lb = lab[a], lab[b]
        apart = la != lb
        if not apart.any():
            return kept
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        _, one = np.unique(np.minimum(la, lb) * len(lab) + np.maximum(la, lb), return_index=True)
        a, b = a[one], b[one]
        root = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = x = root.get(root[x], root[x])
            return x

        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            x, y = find(int(lab[i])), find(int(lab[j]))
            if x != y:
                root[max(x, y)] = min(x, y)
                kept.append((i, j))
        for x in list(root):
            root[x] = find(x)
        old = np.array(list(root), dtype=lab.dtype)
        new = np.array(list(root.values()), dtype=lab.dtype)
        order = np.argsort(old)
        at = np.minimum(np.searchsorted(old[order], lab), len(old) - 1)
        lab[:] = np.where(old[order][at] == lab, new[order][at], lab)


def _near_order(x: np.ndarray) -> np.ndarray:
    """An order in which runs of SQUARE rows lie close together: halves along the widest coordinate, again and again."""
    done, todo = [], [np.arange(len(x))]
    while todo:
        at = todo.pop()
        if len(at) <= SQUARE:
            done.append(at)
            continue
        part = x[at]
        half = -(-len(at) // 2 // SQUARE) * SQUARE
        order = np.argpartition(part[:, np.ptp(part, axis=0).argmax()], half)
        todo += [at[order[half:]], at[order[:half]]]
    return np.concatenate(done) if done else np.zeros(0, dtype=np.int64)


def _compare(cosine: float, frames: dict[int, Frame], kept: str):
    """Links between a tile (side 0) and other vectors (side 1), and within the tile where the group's number is 0."""

    def each(key: tuple, group: pa.Table) -> pa.Table:
        dims, block, k = key[0].as_py(), key[1].as_py(), key[4].as_py()
        parts, budget = frames[dims].parts, frames[dims].budget
        x = _matrix(group["raw"].to_pylist(), kept, dims)
        u = turned(x, frames[dims].turn)
        side = group["side"].to_numpy()
        own, others = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        order = np.concatenate([own[_near_order(u[own, parts[block]])], others[_near_order(u[others, parts[block]])]])
        n_own, ids, weight = len(own), group["id"].to_numpy()[order], group["n"].to_numpy()[order]
        x, u = x[order], u[order]
        here = u[:, parts[block]]
        half, one = (here.astype(np.float64) ** 2).sum(axis=1, keepdims=True).astype(np.float32), np.ones((len(here), 1), np.float32)
        rows, columns = np.hstack([here, half, one]), np.ascontiguousarray(np.hstack([-2 * here, one, half]).T)  # their product is the squared distance
        limit = np.float32(budget[block] + SLACK)
        squares = [(i, min(i + SQUARE, end)) for begin, end in ((0, n_own), (n_own, len(ids))) for i in range(begin, end, SQUARE)]
        low, high = np.array([here[i:e].min(axis=0) for i, e in squares]), np.array([here[i:e].max(axis=0) for i, e in squares])
        links, lab, edges = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids)), []
        for s, (i, e) in enumerate(squares):
            if i >= n_own:
                break
            gap = np.maximum(np.maximum(low - high[s], low[s] - high), 0.0)
            for t in np.flatnonzero((gap * gap).sum(axis=1) <= limit).tolist():
                j, f = squares[t]
                if j < i or k and j < n_own:
                    continue
                at = np.flatnonzero(rows[i:e] @ columns[:, j:f] <= limit)
                a, b = at // (f - j) + i, at % (f - j) + j
                if j == i:
                    a, b = a[a < b], b[a < b]
                for begin in range(0, len(a), 1 << 17):
                    v, w = a[begin : begin + (1 << 17)], b[begin : begin + (1 << 17)]
                    for p in range(block + 1):  # the pair belongs to this block if none before it brings it together
                        apart = u[v, parts[p]].astype(np.float64) - u[w, parts[p]]
                        near = (apart * apart).sum(axis=1) <= budget[p]
                        v, w = (v[near], w[near]) if p == block else (v[~near], w[~near])
                    likely = np.einsum("ij,ij->i", u[v], u[w]) >= cosine - 1e-4
                    v, w = v[likely], w[likely]
                    y, z = x[v], x[w]
                    linked = (y * z).sum(axis=1) >= cosine * np.sqrt((y * y).sum(axis=1)) * np.sqrt((z * z).sum(axis=1))
                    v, w = v[linked], w[linked]
                    np.add.at(links, v, weight[w])
                    np.add.at(links, w, weight[v])
                    edges += _forest(lab, v, w)
        at = np.flatnonzero(links)
        near, far = np.array([x for x, _ in edges], dtype=np.int64), np.array([y for _, y in edges], dtype=np.int64)
        nothing = np.zeros(len(edges), dtype=np.int64)
        return pa.table({"id": np.concatenate([ids[at], ids[near]]), "other": pa.array(np.concatenate([ids[at], ids[far]]), pa.int64()), "links": np.concatenate([links[at], nothing])})

    return each


def embedding_dedup(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", block_dims: int = BLOCK_DIMS, tile_values: int = TILE_VALUES) -> DataFrame:
    """A row for each row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors that are null, empty or zero, or hold null or non-finite parts link
    with nothing; finite ones of any magnitude take part; vectors of different
    dimensions never link; equal vectors always do; of the rows that repeat an
    id the first in byte order takes part and all get its result; a null id is
    never linked and is kept. Other columns are not read. An empty table gives
    an empty table.
    """
    reach = 2 - 2 * cosine
    kept = "<f4" if "float" in vectors.schema[vector_col].dataType.simpleString() else "<f8"
    every = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    one = _checked(every.where("id is not null"), kept).groupBy("id").agg(F.min(F.struct("raw", "dims", "print")).alias("x"))
    checked = save(one.select("id", "x.*"), "checked")
    classes = save(checked.groupBy("dims", "print").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("raw").alias("raw")), "classes")
    frames = {}
    for dims, n in [(r["dims"], r["n"]) for r in classes.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).collect()]:  # a row a dimension
        rows = classes.where(F.col("dims") == dims).select("raw").orderBy(F.xxhash64("id")).limit(SAMPLE).collect()
        frames[dims] = framed(_matrix([r["raw"] for r in rows], kept, dims), n, reach, block_dims, max(1, tile_values // dims))
    placed = save(_placed(classes, frames, kept), "placed")
    cell = ["dims", "block", "leaf"]
    tile = F.greatest(F.lit(1), F.floor(F.lit(tile_values) / F.first("dims")))
    loads = placed.select("dims", F.explode("places").alias("p")).groupBy("dims", "p.block", "p.leaf").agg(*(F.ceil(F.sum((F.col("p.side") == side).cast("long")) / tile).cast("int").alias(name) for side, name in ((0, "tiles"), (1, "guests"))))
    at = placed.select("id", "dims", "n", "raw", F.explode("places").alias("p")).select("id", "dims", "n", "raw", "p.*").join(save(loads, "loads"), cell)
    at = at.withColumn("t", F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.when(F.col("side") == 0, F.col("tiles")).otherwise(F.col("guests")))).cast("int"))
    # tile i meets, in this order: itself, the later tiles of its leaf, the guests; OTHERS of them in a task
    upto = lambda n: F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)))
    row = ["dims", "block", "leaf", "id", "n", "raw"]
    rest = F.col("tiles") - 1 - F.col("t") + F.col("guests")
    hosts = at.where("side = 0").select(*row, F.col("t").alias("i"), upto(F.greatest(F.lit(1), F.ceil(rest / OTHERS).cast("int"))).alias("k"), F.lit(0).alias("side"))
    later = at.where("side = 0 and t > 0").select(*row, "t", upto(F.col("t")).alias("i")).select(*row, "i", F.floor((F.col("t") - F.col("i") - 1) / OTHERS).cast("int").alias("k"), F.lit(1).alias("side"))
    guests = at.where("side = 1").select(*row, "t", "tiles", upto(F.col("tiles")).alias("i")).select(*row, "i", F.floor((F.col("tiles") - 1 - F.col("i") + F.col("t")) / OTHERS).cast("int").alias("k"), F.lit(1).alias("side"))
    meet = hosts.unionByName(later).unionByName(guests)
    found = save(meet.groupBy(*cell, "i", "k").applyInArrow(_compare(cosine, frames, kept), "id long, other long, links long"), "found")
    links = found.where("links > 0").groupBy("id").agg(F.sum("links").alias("links"))
    comps = connected_components(found.where("links = 0"), "id", "other")
    ended = classes.join(links, "id", "left").join(comps, "id", "left").select("dims", "print", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    known = checked.select("id", "dims", "print").join(ended, ["dims", "print"]).select("id", "n_links", "component_id")
    all_ = every.select("id").join(known, "id", "left")
    component = F.coalesce("component_id", "id")
    return all_.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
