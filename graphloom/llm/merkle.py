"""Merkle manifest of a dataset, by Pregel-style supersteps over RDDs.

A leaf is the SHA-256 of a row's fields, and every tree's leaves stand in order.
The position of a leaf comes from a running total over range partitions, so a
tree may hold most of the rows. From there on vertices are keyed (tree, position)
and each superstep is one shuffle of messages, which carries DEPTH levels: the
vertices under one vertex DEPTH levels above, WIDTH of them at most, meet in a
group of their own.

* up: every vertex messages its digest to that group; in it children pass their
  digests to parents level by level, and a parent with all its children hashes
  them. The vertex on top is a sender of the next superstep. A tree ends at the
  vertex that is alone on its level.
* The ends of all trees are the leaves of one more tree, whose end is the root.
* down, the supersteps in reverse: a vertex knows the siblings on its way to the
  root and broadcasts them to the vertices below, each with its own siblings.

Groups are of bounded size whatever the tree, and each superstep has 1/WIDTH of
the messages of the one below. A lost executor costs the shuffles that it held:
nothing is kept beside them but the tables of leaves and of tree ends in the
shared folder.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans import running_total, save, ship, shuffle_partitions

FAN_OUT = 3
#: Levels of a superstep, and the vertices of a group.
DEPTH = 4
WIDTH = FAN_OUT**DEPTH
#: Steps to the root: (place in the run, digests of the others in it), from the lowest level up.
Steps = tuple[tuple[int, tuple[bytes, ...]], ...]


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 of the fields one after another: "-" for null, else the UTF-8 byte count, ":" and the value as text."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def joined(digests: list[bytes]) -> bytes:
    """The digest of a run: SHA-256 of its members' hex texts."""
    return sha256("".join(d.hex() for d in digests).encode()).digest()


def fold(digest: bytes, steps: Steps) -> bytes:
    """The root that a leaf and the siblings on its way give."""
    for place, others in steps:
        digest = joined([*others[:place], digest, *others[place:]])
    return digest


def _partition(key: tuple) -> int:
    return zlib.crc32(repr(key).encode("utf-8", "surrogatepass"))


def _meet(parts: int, *sides: RDD) -> RDD:
    """Records of several RDDs of the same keys: (key, [(side, value)])."""
    tagged = [side.mapValues(lambda v, n=n: (n, v)) for n, side in enumerate(sides)]
    both = tagged[0]
    for side in tagged[1:]:
        both = both.union(side)
    return both.groupByKey(parts, _partition)


def _to_group(node: tuple) -> tuple:
    (tree, i), (digest, n) = node
    return (tree, i // WIDTH), (i % WIDTH, digest, n)


def _levels(digests: list[bytes], n: int) -> tuple[list[list[bytes]], int]:
    """The levels of a group from its lowest one of a tree's n vertices on, and how many vertices the tree has where the group ends."""
    out = [digests]
    while n > 1 and len(out) <= DEPTH:
        out.append([joined(out[-1][i : i + FAN_OUT]) for i in range(0, len(out[-1]), FAN_OUT)])
        n = -(-n // FAN_OUT)
    return out, n


def _ways(digests: list[bytes], n: int) -> Iterator[Steps]:
    """For each member of a group the steps to the vertex on top."""
    levels, _ = _levels(digests, n)
    for i in range(len(digests)):
        steps = []
        for level in levels[:-1]:
            place, run = i % FAN_OUT, level[i - i % FAN_OUT : i - i % FAN_OUT + FAN_OUT]
            steps.append((place, tuple(run[:place] + run[place + 1 :])))
            i //= FAN_OUT
        yield tuple(steps)


def _completed(node: tuple) -> tuple:
    """The vertex on top of a group that has heard from all: ((tree, i), (digest, vertices on its level, members, vertices on theirs))."""
    (tree, i), told = node
    told = sorted(told)
    n = told[0][2]
    if len(told) != min(WIDTH, n - WIDTH * i):
        raise RuntimeError(f"group {i} of tree {tree!r} has heard from {len(told)} vertices only")
    members = [digest for _, digest, _ in told]
    levels, above = _levels(members, n)
    return (tree, i), (levels[-1][0], above, members, n)


def _climb(nodes: RDD, most: int, parts: int) -> list[RDD]:
    """Supersteps up from ((tree, i), (digest, vertices on its level)); ``most``: vertices of the largest tree. One RDD a superstep."""
    tops = []
    while most > 1:
        tops.append(nodes.filter(lambda node: node[1][1] > 1).map(_to_group).groupByKey(max(1, parts // WIDTH ** len(tops)), _partition).map(_completed))
        nodes, most = tops[-1].mapValues(lambda v: v[:2]), -(-most // WIDTH)
    return tops


def _to_members(met: tuple) -> Iterator[tuple]:
    (tree, i), records = met
    sides = dict(records)
    if 1 in sides:
        (_, _, members, n), (steps, *ends) = sides[0], sides[1]
        for place, own in enumerate(_ways(members, n)):
            yield (tree, WIDTH * i + place), (own + steps, *ends)


def _height(n: int) -> int:
    """Supersteps of a tree of n leaves."""
    out = 0
    while n > 1:
        n, out = -(-n // WIDTH), out + 1
    return out


def _descend(tops: list[RDD], ends: RDD, parts: int) -> RDD:
    """Supersteps down to the groups of leaves: ((tree, i), (steps, ...)). ends: ((tree, 0), (height, (steps, ...)))."""
    paths = None
    for height in range(len(tops), 0, -1):
        here = ends.filter(lambda end, h=height: max(1, end[1][0]) == h).mapValues(lambda v: v[1])
        paths = here if paths is None else paths.union(here)
        if height > 1:
            paths = _meet(max(1, parts // WIDTH ** (height - 1)), tops[height - 1], paths).flatMap(_to_members)
    return ends.mapValues(lambda v: v[1]) if paths is None else paths


def _to_leaves(met: tuple) -> Iterator[tuple]:
    """The last superstep: a group of leaves and the path of the vertex on top."""
    _, records = met
    run = sorted(v for side, v in records if side == 0)
    steps, end, root = next(v for side, v in records if side == 1)
    for (_, leaf, seen, _, order, tree), own in zip(run, _ways([x[1] for x in run], run[0][3]), strict=True):
        own += steps
        proof = [d.hex() for _, others in own for d in others]
        yield order, tree, leaf.hex(), end.hex(), root.hex(), proof, [p for p, _ in own], [len(others) for _, others in own], fold(seen, own).hex()


def manifest(docs: DataFrame, columns: list[str], by: str = "source", order: str = "doc_id", seen: dict[str, Column] | None = None) -> DataFrame:
    """One row for each row: ``order``, ``by``, leaf, subroot, root, proof, places, runs, folded_root.

    The leaf is made of ``columns``, a tree of the rows of one ``by``; leaves
    ascend by ``order``, nulls first, and rows of one ``order`` by their digest.
    ``proof`` has the siblings' digests on the way from the leaf to the root,
    level by level and left to right; ``places`` and ``runs`` say for each level
    where in its run the way passes and how many siblings there are.
    ``folded_root`` is what the proof gives for the row as it is ``seen``:
    columns by name that are put in place of those of ``docs``.

    A null ``by`` is a tree of its own, the first; rows that repeat are leaves
    of their own; columns beside those named are not read, so clashing names do
    no harm; an empty table gives an empty table.
    """
    spark, seen = docs.sparkSession, seen or {}
    ship(spark)
    now = [seen.get(c, F.col(f"`{c}`")) for c in columns]
    rows = docs.select(F.col(f"`{order}`").alias("order"), F.col(f"`{by}`").alias("tree"), F.unhex(leaf_digest([F.col(f"`{c}`") for c in columns])).alias("leaf"), F.unhex(leaf_digest(now)).alias("seen"), F.monotonically_increasing_id().alias("at"))
    # rows alike in all but their number are interchangeable, and the number lets a range of them be split
    placed = running_total(save(rows, "leaves"), ["tree"], [F.col("order"), F.col("leaf"), F.col("at")], F.lit(1).cast("long"), "i", total="n")
    placed, parts = save(placed.select("order", "tree", "leaf", "seen", "i", "n"), "placed"), shuffle_partitions(spark)
    most = placed.agg(F.max("n")).first()[0] or 0
    leaves = placed.rdd.map(tuple)
    tops = _climb(leaves.map(lambda r: ((r[1], r[4]), (bytes(r[2]), r[5]))), most, parts)

    ends = leaves.filter(lambda r: r[5] == 1).map(lambda r: (r[1], bytes(r[2]), 0))
    for height, top in enumerate(tops, 1):
        ends = ends.union(top.filter(lambda node: node[1][1] == 1).map(lambda node, h=height: (node[0][0], node[1][0], h)))
    kind = placed.schema["tree"].dataType.simpleString()
    ends = save(spark.createDataFrame(ends, f"tree {kind}, digest binary, height int", verifySchema=False).coalesce(parts), "ends")
    ends = save(running_total(ends.withColumn("all", F.lit(0)), ["all"], [F.col("tree")], F.lit(1).cast("long"), "i", total="n"), "ends")
    n_trees = ends.agg(F.max("n")).first()[0] or 0
    trees = ends.rdd.map(lambda r: (r["i"], (r["tree"], bytes(r["digest"]), r["height"], r["n"])))
    above = _climb(trees.map(lambda t: ((0, t[0]), (t[1][1], t[1][3]))), n_trees, parts)
    # the vertex that is alone on top of the upper tree, or the only tree's end
    root = above[-1].first()[1][0] if above else next(iter(trees.map(lambda t: t[1][1]).collect()), b"")
    paths = _descend(above, spark.sparkContext.parallelize([((0, 0), (_height(n_trees), ((),)))], 1), parts)

    def to_trees(met: tuple) -> Iterator[tuple]:
        _, records = met
        run = sorted(v for side, v in records if side == 0)
        (steps,) = next(v for side, v in records if side == 1)
        for (_, n, digest, height, tree), own in zip(run, _ways([v[2] for v in run], run[0][1]) if run else (), strict=True):
            yield (tree, 0), (height, (own + steps, digest, root))

    runs = trees.map(lambda t: ((0, t[0] // WIDTH), (t[0] % WIDTH, t[1][3], t[1][1], t[1][2], t[1][0])))
    paths = _descend(tops, _meet(max(1, parts // WIDTH), runs, paths).flatMap(to_trees), parts)
    runs = leaves.map(lambda r: ((r[1], r[4] // WIDTH), (r[4] % WIDTH, bytes(r[2]), bytes(r[3]), r[5], r[0], r[1])))
    found = _meet(parts, runs, paths).flatMap(_to_leaves)
    schema = f"`order` {placed.schema['order'].dataType.simpleString()}, tree {kind}, leaf string, subroot string, root string, proof array<string>, places array<int>, runs array<int>, folded_root string"
    out = spark.createDataFrame(found, schema, verifySchema=False)
    return out.select(F.col("order").alias(order), F.col("tree").alias(by), *out.columns[2:])
