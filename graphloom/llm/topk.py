"""Exact top-k search by inner product with a paged M-tree.

Vectors become points of a metric space in which the nearest point has the
largest inner product: x gets one more coordinate, sqrt(M - |x|^2) with M the
largest squared norm, queries get 0, so that
d(q, x)^2 = |q|^2 + M - 2 q.x.

Index, from the root down: top nodes around pivots of a bounded sample; below
each of them subtrees around pivots sampled from its rows; below these, pages
of at most PAGE entries. Nodes store their pivot and covering radius, pages and
entries also their distance to the pivot above. Pages and subtrees keep their
size as the table grows; there are at most MOST_TOPS top nodes, so beyond that
the list of a top node's subtree pivots grows with the table. Every row is
indexed.

Search, best first: a query descends to the subtree of its nearest pivot, which
gives the bound of its k-th best score, and then into those subtrees alone
whose ball, and whose parent's ball, can hold a better one. Pages go only to
the blocks of queries that were sent to their subtree. Within a subtree pages
wait in a heap by their least possible distance, first judged by stored
distances and the triangle inequality and only then by a computed one; the same
goes for the entries of an opened page. Scores are exact integers.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.batches import map_batches
from graphloom.llm.vectors import by_dimension
from graphloom.plans import running_total, save

PAGE, SUBTREE, MOST_TOPS, QUERY_BLOCK = 128, 4096, 512, 2048
#: Rows of a top node that one task deals to its subtrees.
DEALT = 65_536
#: Page distances that a search computes together, and pages it opens together at most.
AT_ONCE = 32
#: Components from here on are kept as they are, in a tree of their own, and multiplied as Python integers.
WIDE = 2.0**23
_PAGES = "kind int, top int, sub int, piece int, page int, head binary, pivot binary, radius double, parent double, ids binary, points binary, apart binary"
_LONG = (1 << 63) - 1


@dataclass
class Space:
    """One kind of points: a dimension (kind // 2), narrow (even) or wide (odd); wide ones are measured in units of 2**shift."""

    kind: int
    shift: int
    most: float
    scale: float
    tops: list[bytes] = field(default_factory=list)
    radius: dict[int, float] = field(default_factory=dict)

    def points(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(points in units of the space, their extra coordinate)."""
        x = measured(found, self.kind, self.shift, self.scale)
        return x, np.sqrt(np.maximum(self.most - (x * x).sum(axis=1), 0.0))


def measured(points: list[bytes], kind: int, shift: int, scale: float) -> np.ndarray:
    if not kind % 2:
        return np.frombuffer(b"".join(points), "<i4").reshape(-1, kind // 2).astype(np.float64)
    x = np.frombuffer(b"".join(points), "<f8").reshape(-1, kind // 2)
    small = np.abs(x) < 2.0**900
    return np.where(small, np.ldexp(np.floor(scale * np.where(small, x, 0.0)), -shift), np.ldexp(x, math.frexp(scale)[1] - 1 - shift) * (scale / 2.0 ** (math.frexp(scale)[1] - 1)))


def integers(point: bytes, kind: int, scale: float) -> list[int]:
    if not kind % 2:
        return np.frombuffer(point, "<i4").tolist()
    top, below = scale.as_integer_ratio()
    return [math.floor(scale * x) if abs(x) < 2.0**900 else int(x) * top // below for x in np.frombuffer(point, "<f8").tolist()]


def key_of(score: int) -> str:
    """Text that sorts as the scores do, whatever their size."""
    h = f"{abs(score):x}"
    return f"p{len(h):04d}{h}" if score >= 0 else f"n{9999 - len(h):04d}" + "".join(f"{15 - int(c, 16):x}" for c in h)


def score_of(key: str) -> int:
    return int(key[5:], 16) if key[0] == "p" else -int("".join(f"{15 - int(c, 16):x}" for c in key[5:]), 16)


def _in_units(score: int, shift: int) -> float:
    over = max(0, score.bit_length() - 900)
    try:
        return math.ldexp(float(score >> over), over - shift)
    except OverflowError:
        return math.inf if score > 0 else -math.inf


def _points(vectors: DataFrame, scale: float) -> DataFrame:
    """id, kind, point, norm (squared, of narrow points) and expo of the vectors that take part."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            out = []
            for rows, x in by_dimension(batch.column(1)):
                wide = (np.abs(x) >= WIDE / scale).any(axis=1)
                v = np.floor(scale * np.where(wide[:, None], 0.0, x))
                data = [x[i].astype("<f8").tobytes() if w else v[i].astype("<i4").tobytes() for i, w in enumerate(wide.tolist())]
                expo = np.frexp(np.abs(x).max(axis=1))[1] + math.frexp(scale)[1]
                columns = [batch.column(0).take(pa.array(rows)), pa.array((2 * x.shape[1] + wide).astype(np.int32)), pa.array(data, pa.binary()), pa.array((v * v).sum(axis=1)), pa.array(np.where(wide, expo, 0).astype(np.int32))]
                out.append(pa.record_batch(columns, ["id", "kind", "point", "norm", "expo"]))
            return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if out else None

        return each

    return map_batches(vectors, make, "id long, kind int, point binary, norm double, expo int")


def between(x: np.ndarray, ex: np.ndarray, y: np.ndarray, ey: np.ndarray) -> np.ndarray:
    """Distances of all x from all y."""
    d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T + (ex[:, None] - ey[None, :]) ** 2
    return np.sqrt(np.maximum(d, 0.0))


class Query:
    """A query's point in its own units, and how far a score lies away in a space."""

    def __init__(self, kind: int, point: bytes, expo: int, scale: float) -> None:
        self.shift = expo if kind % 2 else 0
        self.x = measured([point], kind, self.shift, scale)
        self.norm = float((self.x * self.x).sum())

    def base(self, space: Space) -> float:
        return self.norm + space.most

    def slack(self, space: Space) -> float:
        return 1e-6 * math.sqrt(self.base(space)) + (0.0 if space.kind % 2 or self.shift else 1e-6)

    def far(self, score: int, space: Space) -> float:
        return math.sqrt(max(self.base(space) - 2 * _in_units(score, self.shift + space.shift), 0.0)) + self.slack(space)

    def from_all(self, y: np.ndarray, ey: np.ndarray) -> np.ndarray:
        return between(self.x, np.zeros(1), y, ey)[0]


def _home_top(spaces: dict[int, Space]):
    def make():
        lifted = {k: s.points(s.tops) for k, s in spaces.items()}

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            kinds, points = batch["kind"].to_numpy(), batch["point"].to_pylist()
            top, apart = np.zeros(len(kinds), dtype=np.int32), np.zeros(len(kinds))
            for k in np.unique(kinds):
                at = np.flatnonzero(kinds == k)
                gap = between(*spaces[k].points([points[i] for i in at]), *lifted[k])
                top[at], apart[at] = gap.argmin(axis=1), gap.min(axis=1)
            return pa.record_batch([batch["id"], batch["kind"], batch["point"], pa.array(top), pa.array(apart)], ["id", "kind", "point", "top", "apart"])

        return each

    return make


def _home_sub(spaces: dict[int, Space]):
    """Rows of a top node to the nearest of its subtrees."""

    def each(rows: pa.Table, nodes: pa.Table) -> pa.Table:
        if not len(rows):
            return pa.table({"id": pa.array([], pa.int64()), "kind": pa.array([], pa.int32()), "top": pa.array([], pa.int32()), "sub": pa.array([], pa.int32()), "point": pa.array([], pa.binary()), "apart": pa.array([], pa.float64())})
        space = spaces[rows["kind"][0].as_py()]
        pivots = space.points(nodes["pivots"][0].as_py())
        points, sub, apart = rows["point"].to_pylist(), [], []
        for begin in range(0, len(points), 4096):
            gap = between(*space.points(points[begin : begin + 4096]), *pivots)
            sub.append(gap.argmin(axis=1))
            apart.append(gap.min(axis=1))
        return pa.table({"id": rows["id"], "kind": rows["kind"], "top": rows["top"], "sub": pa.array(np.concatenate(sub).astype(np.int32)), "point": rows["point"], "apart": pa.array(np.concatenate(apart))})

    return each


def _pages(spaces: dict[int, Space], page: int):
    """Bulk load of a piece of a subtree: rows go to the nearest of evenly spread page pivots, long pages are cut."""

    def each(key: tuple, group: pa.Table) -> pa.Table:
        kind = key[0].as_py()
        space, width = spaces[kind], np.dtype("<f8" if kind % 2 else "<i4")
        ids = group["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, points = ids[order], group["point"].combine_chunks().take(pa.array(order)).to_pylist()
        x, ex = space.points(points)
        heads = np.linspace(0, len(ids) - 1, -(-len(ids) // (page // 2)), dtype=int)
        home = np.argmin(between(x, ex, x[heads], ex[heads]), axis=1)
        whole = np.frombuffer(b"".join(points), width).reshape(len(points), -1)
        rows = []
        for h in range(len(heads)):
            mine = np.flatnonzero(home == h)
            for begin in range(0, len(mine), page):
                at = mine[begin : begin + page]
                apart = between(x[at[:1]], ex[at[:1]], x[at], ex[at])[0]
                parent = float(between(x[at[:1]], ex[at[:1]], x[:1], ex[:1])[0, 0])
                rows.append((*(k.as_py() for k in key), len(rows), points[0], points[at[0]], float(apart.max()), parent, ids[at].astype("<i8").tobytes(), whole[at].tobytes(), apart.astype("<f8").tobytes()))
        types = [pa.int32()] * 5 + [pa.binary()] * 2 + [pa.float64()] * 2 + [pa.binary()] * 3
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in _PAGES.split(", ")])

    return each


def _search(k: int, spaces: dict[int, Space], scale: float):
    """Best-first search of a block of queries in one piece of a subtree."""

    def each(queries: pa.Table, pages: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if len(queries) and len(pages):
            kind = pages["kind"][0].as_py()
            space, width = spaces[kind], np.dtype("<f8" if kind % 2 else "<i4")
            top, etop = space.points(pages["head"].slice(0, 1).to_pylist())
            heads, eheads = space.points(pages["pivot"].to_pylist())
            radius, parent = pages["radius"].to_numpy(), pages["parent"].to_numpy()
            ids, raw, apart = (np.frombuffer(b"".join(pages[c].to_pylist()), t) for c, t in (("ids", "<i8"), ("points", width), ("apart", "<f8")))
            raw = raw.reshape(-1, kind // 2)
            sizes = np.array([len(b) // 8 for b in pages["ids"].to_pylist()])
            ends = np.cumsum(sizes)
            doubles, longs = raw.astype(np.float64), None if kind % 2 else raw.astype(np.int64)
            for query_id, q_kind, point, expo, floor in zip(*(queries[c].to_pylist() for c in ("id", "q_kind", "point", "expo", "floor")), strict=True):
                query = Query(q_kind, point, expo, scale)
                narrow = not (q_kind % 2 or kind % 2)
                exact = narrow and query.norm * space.most < 2.0**105  # every sum of products is an exact double
                q = query.x[0] if exact else np.frombuffer(point, "<i4").astype(np.int64) if narrow else integers(point, q_kind, scale)
                from_top = float(query.from_all(top, etop)[0])
                best: list[tuple[int, int]] = []  # heap of (score, -id), the worst first
                limit = query.far(score_of(floor), space) if floor is not None else math.inf
                slack = query.slack(space)
                waiting = [(float(b), i, -1.0) for i, b in enumerate(np.abs(from_top - parent) - radius - slack)]
                heapq.heapify(waiting)
                at_once = 1  # the best page alone sets a bound; the further, the more are opened together
                while waiting and waiting[0][0] <= limit:
                    if waiting[0][2] < 0:  # pages known by stored distances only: compute theirs, some at a time
                        some = []
                        while waiting and waiting[0][2] < 0 and waiting[0][0] <= limit and len(some) < AT_ONCE:
                            some.append(heapq.heappop(waiting)[1])
                        gaps = query.from_all(heads[some], eheads[some])
                        for i, d in zip(some, gaps.tolist(), strict=True):
                            if d - radius[i] <= limit:
                                heapq.heappush(waiting, (d - float(radius[i]), i, d))
                        continue
                    opened, gaps = [], []
                    while waiting and waiting[0][2] >= 0 and waiting[0][0] <= limit and len(opened) < at_once:
                        _, i, d = heapq.heappop(waiting)
                        opened.append(i)
                        gaps.append(d)
                    at_once = min(AT_ONCE, 2 * at_once)
                    n = sizes[opened]
                    at = np.repeat(ends[opened] - np.cumsum(n), n) + np.arange(n.sum())
                    at = at[(np.abs(np.repeat(gaps, n) - apart[at]) <= limit) & (ids[at] != query_id)]
                    if not len(at):
                        continue
                    if narrow:
                        scores = (doubles if exact else longs)[at] @ q
                        if len(best) == k:
                            good = scores >= best[0][0]
                            scores, at = scores[good], at[good]
                        if len(scores) > 2 * k:
                            good = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                            scores, at = scores[good], at[good]
                        scores = scores.tolist()
                    else:
                        scores = [sum(map(mul, q, integers(raw[j].tobytes(), kind, scale))) for j in at.tolist()]
                    for score, other in zip(scores, ids[at].tolist(), strict=True):
                        item = (int(score), -other)
                        if len(best) < k or item > best[0]:
                            (heapq.heappush if len(best) < k else heapq.heapreplace)(best, item)
                    if len(best) == k:
                        limit = min(limit, query.far(best[0][0], space))
                out += [(query_id, -other, score) for score, other in best]
        a, b, scores = zip(*out, strict=True) if out else ((), (), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([max(-_LONG - 1, min(_LONG, s)) for s in scores], pa.int64()), pa.array(list(map(key_of, scores)), pa.string())], names=["query_id", "vec_id", "score", "key"])

    return each


def _route_tops(spaces: dict[int, Space], scale: float, first: bool):
    """Queries to top nodes: the nearest one, or all whose ball may hold a score of at least the floor."""
    asked = ["id", "q_kind", "point", "expo", "block", "floor"]

    def make():
        lifted = {k: s.points(s.tops) for k, s in spaces.items()}

        def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            rows, kinds, tops = [], [], []
            for i, (q_kind, point, expo, floor) in enumerate(zip(*(batch[c].to_pylist() for c in ("q_kind", "point", "expo", "floor")), strict=True)):
                query = Query(q_kind, point, expo, scale)
                for kind in (q_kind // 2 * 2, q_kind // 2 * 2 + 1):
                    if kind not in spaces:
                        continue
                    space, gap = spaces[kind], query.from_all(*lifted[kind])
                    if first:
                        found = [int(gap.argmin())]
                    else:
                        radius = np.array([space.radius.get(t, -math.inf) for t in range(len(gap))])
                        limit = math.inf if floor is None else query.far(score_of(floor), space)
                        found = np.flatnonzero((radius > -math.inf) & (gap - radius <= limit)).tolist()
                    rows += [i] * len(found)
                    kinds += [kind] * len(found)
                    tops += found
                    if first:
                        break
            return pa.record_batch([*(batch[c].take(pa.array(rows, pa.int64())) for c in asked), pa.array(kinds, pa.int32()), pa.array(tops, pa.int32())], [*asked, "kind", "top"]) if rows else None

        return each

    return make


def _route_subs(spaces: dict[int, Space], scale: float, first: bool):
    """Queries at a top node to pieces of its subtrees: of the nearest one, or of all whose ball may hold a score of at least the floor."""

    def each(queries: pa.Table, roots: pa.Table) -> pa.Table:
        rows, subs, pieces = [], [], []
        if len(queries) and len(roots):
            space = spaces[roots["kind"][0].as_py()]
            lifted, radius = space.points(roots["pivot"].to_pylist()), roots["radius"].to_numpy()
            sub, n = roots["sub"].to_numpy(), roots["pieces"].to_pylist()
            for i, (q_kind, point, expo, floor) in enumerate(zip(*(queries[c].to_pylist() for c in ("q_kind", "point", "expo", "floor")), strict=True)):
                query = Query(q_kind, point, expo, scale)
                gap = query.from_all(*lifted)
                limit = math.inf if floor is None else query.far(score_of(floor), space)
                for s in [int(gap.argmin())] if first else np.flatnonzero(gap - radius <= limit).tolist():
                    rows += [i] * n[s]
                    subs += [int(sub[s])] * n[s]
                    pieces += range(n[s])
        kept = queries.take(pa.array(rows, pa.int64()))
        return kept.append_column("sub", pa.array(subs, pa.int32())).append_column("piece", pa.array(pieces, pa.int32()))

    return each


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("key"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", page: int = PAGE, subtree: int = SUBTREE, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest inner products over all rows of other ids.

    Parts become floor(scale * x) in double. Vectors that are null, empty or
    hold null or non-finite parts and rows without an id take no part; only
    vectors of the query's dimension are candidates; of rows that repeat an id
    the first in byte order counts. Ties go to the smaller id. Fewer than k
    candidates give fewer rows; no queries or no rows give none. Finite parts
    of any size take part and ranks follow the exact scores; a score beyond the
    range of a long is shown as the end of that range.
    """
    spark = vectors.sparkSession
    narrow = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where("id is not null")
    one = lambda df: _points(narrow(df), scale).groupBy("id").agg(F.min(F.struct("kind", "point", "norm", "expo")).alias("x")).select("id", "x.*")
    items, asked = save(one(vectors), "points"), save(one(queries), "queries")
    spaces, tops = {}, []
    for r in items.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("norm"), F.max("expo").alias("expo")).collect():  # a row a kind
        kind, wide = r["kind"], r["kind"] % 2
        sample = items.where(F.col("kind") == kind).orderBy(F.xxhash64("id"), "id").limit(min(MOST_TOPS, -(-r["n"] // (8 * subtree)))).select("point").collect()
        spaces[kind] = Space(kind, r["expo"], float(kind // 2) + 1.0 if wide else r["norm"] + 1.0, scale, [x["point"] for x in sample])
        tops += [(kind, t, p) for t, p in enumerate(spaces[kind].tops)]
    homed = save(map_batches(items.select("id", "kind", "point"), _home_top(spaces), "id long, kind int, point binary, top int, apart double"), "homed")
    shares = []
    for r in homed.groupBy("kind", "top").agg(F.count(F.lit(1)).alias("n"), F.max("apart").alias("radius")).collect():  # a row a top node
        spaces[r["kind"]].radius[r["top"]] = r["radius"]
        shares.append((r["kind"], r["top"], -(-r["n"] // max(subtree, DEALT))))
    pieces = F.broadcast(spark.createDataFrame(shares, "kind int, top int, shares int"))  # at most MOST_TOPS rows a kind
    at = ["kind", "top"]
    sampled = homed.where(F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(subtree)) == 0).select("kind", "top", "point")
    nodes = sampled.unionByName(spark.createDataFrame(tops, "kind int, top int, point binary")).groupBy(*at).agg(F.sort_array(F.collect_set("point")).alias("pivots"))
    nodes = save(nodes, "nodes")
    rows = homed.join(pieces, at).withColumn("share", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int")).select("id", *at, "share", "point")
    copies = nodes.join(pieces, at).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    dealt = rows.groupBy(*at, "share").cogroup(copies.groupBy(*at, "share")).applyInArrow(_home_sub(spaces), "id long, kind int, top int, sub int, point binary, apart double")
    dealt = save(dealt, "dealt")
    sizes = dealt.groupBy(*at, "sub").agg(F.max("apart").alias("radius"), F.ceil(F.count(F.lit(1)) / subtree).cast("int").alias("pieces"))
    roots = save(nodes.select(*at, F.posexplode("pivots").alias("sub", "pivot")).join(sizes, [*at, "sub"]), "roots")
    split = dealt.join(roots.select(*at, "sub", "pieces"), [*at, "sub"]).withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
    pages = save(split.select("id", *at, "sub", "piece", "point").groupBy(*at, "sub", "piece").applyInArrow(_pages(spaces, page), _PAGES), "pages")

    def routed(asked: DataFrame, first: bool) -> DataFrame:
        sent = save(map_batches(asked.select("id", "q_kind", "point", "expo", "block", "floor"), _route_tops(spaces, scale, first), "id long, q_kind int, point binary, expo int, block int, floor string, kind int, top int"), "sent")
        needed = roots.join(sent.select(*at, F.col("block").alias("b")).distinct(), at).withColumnRenamed("b", "block")
        schema = "id long, q_kind int, point binary, expo int, block int, floor string, kind int, top int, sub int, piece int"
        return save(sent.groupBy(*at, "block").cogroup(needed.groupBy(*at, "block")).applyInArrow(_route_subs(spaces, scale, first), schema), "routed")

    def visit(sent: DataFrame) -> DataFrame:
        key = [*at, "sub", "piece", "block"]
        needed = pages.join(sent.select(*key[:4], F.col("block").alias("b")).distinct(), key[:4]).withColumnRenamed("b", "block")
        return sent.groupBy(*key).cogroup(needed.groupBy(*key)).applyInArrow(_search(k, spaces, scale), "query_id long, vec_id long, score long, key string")

    blocks = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-asked.count() // query_block)))).cast("int")
    asked = asked.withColumnRenamed("kind", "q_kind").drop("norm")
    nearest = routed(asked.withColumns({"block": blocks, "floor": F.lit(None).cast("string")}), True)
    home = save(_ranked(visit(nearest), k).drop("rank"), "home")
    floors = home.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count(F.lit(1)) == k, F.min("key")).alias("floor"))
    # then blocks of queries that live side by side, so that a block is sent to few subtrees
    seen = nearest.select("id", *at, "sub").distinct()
    lined = running_total(seen.withColumn("g", F.lit(0)), ["g"], [*map(F.col, [*at, "sub", "id"])], F.lit(1).cast("long"), "place")
    lined = lined.select("id", F.floor(F.col("place") / query_block).cast("int").alias("block"))
    others = routed(asked.join(lined, "id").join(floors, "id", "left"), False).join(seen, ["id", *at, "sub"], "left_anti")
    rest = visit(others)
    return _ranked(home.unionByName(rest), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
