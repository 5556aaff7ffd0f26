"""MinHash near-dedup by a multi-index Hamming join.

A document's word shingles give a signature of POSITIONS min-hashes of eight
bits each. Two signatures are as far apart as the positions in which they
differ. The positions are split into chunks; if two signatures differ in at
most THRESHOLD < 2 * CHUNKS positions, some chunk differs in at most one of
them (pigeonhole), so an index key for every chunk and every position left out
of it brings all pairs under the threshold together: SIZE keys a chunk, one of
which two such documents share. At similarity 0.8 the expected distance is 15.6
of 78 and the threshold 25; pairs beyond it still meet unless all 13 chunks
differ twice or more, which leaves about one pair in a million.

Links need no list of all pairs:

* equal shingle sets fall into one class first, and one member stands for it;
* classes that share keys, directly or by others, form clusters; a cluster is
  cut into tiles of bounded size, those that share a hub side by side;
* a task takes one tile, or two that share a key, compares signatures and
  confirms every pair that shares a key on its full shingle sets, the closest
  first. Pairs whose ends are joined already are passed over, so a group of near
  copies costs little more than its size, and only a spanning forest comes out;
* each tile first meets itself and the hub's tile; after that only tiles with
  a key that is still in different components meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.batches import as_bytes, map_batches
from graphloom.plans import connected_components, running_total, save

CHUNKS, SIZE = 13, 6
POSITIONS = CHUNKS * SIZE
THRESHOLD = 2 * CHUNKS - 1
#: Load of a tile: a document counts 2,000 and its shingles.
TILE = 1_000_000
_U = np.uint64
_STEP, _FINAL = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)


def _multipliers() -> np.ndarray:
    return np.random.default_rng(20).integers(1, 1 << 63, POSITIONS, dtype=np.uint64) * _U(2) + _U(1)


class Shingler:
    """Sorted distinct 64-bit shingle hashes of whole texts; words are hashed once a task."""

    def __init__(self, words: int) -> None:
        self.words, self.known = words, {}

    def sets(self, text: bytes) -> np.ndarray:
        found = text.lower().split()
        if len(self.known) > 500_000:
            self.known = {}
        known = self.known
        for w in set(found).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, found), dtype=np.uint64, count=len(found))
        if not len(h):
            return h
        k = min(self.words, len(h))
        n = len(h) - k + 1
        total = np.full(n, k, dtype=np.uint64) * _FINAL
        for i in range(k):
            total = (total ^ (total >> _U(29))) * _STEP + h[i : i + n]
        return np.unique((total ^ (total >> _U(32))) * _FINAL)


def signature(shingles: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """The low eight bits of the least hash of each of the permutations."""
    least = np.full(len(multipliers), np.iinfo(np.uint64).max, dtype=np.uint64)
    for begin in range(0, len(shingles), 4096):
        h = shingles[begin : begin + 4096, None] * multipliers
        np.minimum(least, (h ^ (h >> _U(31))).min(axis=0), out=least)
    return ((least * _FINAL) >> _U(56)).astype(np.uint8)


def index_keys(signatures: np.ndarray) -> np.ndarray:
    """(documents, POSITIONS) keys: for each chunk and each position left out, a hash of the other positions."""
    n = len(signatures)
    chunks = signatures.reshape(n, CHUNKS, SIZE).astype(np.uint64) << (_U(8) * np.arange(SIZE, dtype=np.uint64))
    whole = chunks.sum(axis=2, dtype=np.uint64)
    left = whole[:, :, None] - chunks
    name = np.arange(POSITIONS, dtype=np.uint64).reshape(CHUNKS, SIZE) + _U(1)
    x = (left + name * _U(1 << 49)) * _STEP
    x = (x ^ (x >> _U(32))) * _FINAL
    return (x ^ (x >> _U(29))).reshape(n, POSITIONS)


def _signed(docs: DataFrame, words: int) -> DataFrame:
    def make():
        shingler, multipliers = Shingler(words), _multipliers()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, prints, signs = [], [], []
            for text in as_bytes(batch.column(1)):
                s = shingler.sets(text)
                n.append(len(s))
                prints.append(xxhash.xxh3_128_digest(s.tobytes()))
                signs.append(signature(s, multipliers).tobytes() if len(s) else None)
            return pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(signs, pa.binary())], ["id", "n_shingles", "print", "signature"])

        return each

    return map_batches(docs, make, "id long, n_shingles long, print binary, signature binary")


def _keys(classes: DataFrame) -> DataFrame:
    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            signs = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(-1, POSITIONS)
            return pa.record_batch([pa.array(index_keys(signs).reshape(-1).view(np.int64)), batch.column(0).take(pa.array(np.repeat(np.arange(len(signs)), POSITIONS)))], ["key", "id"])

        return each

    return map_batches(classes.select("id", "signature"), make, "key long, id long")


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Sorted distinct shingles reach the similarity."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y):
        return False
    both = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _compare(percent: int):
    """Links of one or two tiles that join components: rows id, comp, tile, signature, shingles."""

    def each(key: tuple, group: pa.Table) -> pa.Table:
        t1, t2 = key[1].as_py(), key[2].as_py()
        ids, comps = group["id"].to_numpy(), group["comp"].to_numpy()
        tile = group["tile"].to_numpy()
        signs = np.frombuffer(b"".join(group["signature"].to_pylist()), dtype=np.uint8).reshape(-1, POSITIONS)
        sets = [np.frombuffer(x, "<u8") for x in group["shingles"].to_pylist()]
        size = np.array([len(x) for x in sets], dtype=np.int64)
        left = np.flatnonzero(tile == t1)
        right = left if t1 == t2 else np.flatnonzero(tile == t2)
        found = []
        for i in left.tolist():
            other = right[right > i] if t1 == t2 else right
            fits = (100 * size[other] >= percent * size[i]) & (100 * size[i] >= percent * size[other])
            other = other[(comps[other] != comps[i]) & fits]
            apart = (signs[other] != signs[i]).reshape(-1, CHUNKS, SIZE).sum(axis=2, dtype=np.uint8)
            near = (apart <= 1).any(axis=1)  # what sharing a key means
            found.append(np.stack([apart[near].sum(axis=1, dtype=np.int64), np.full(int(near.sum()), i), other[near]], axis=1))
        pairs = np.concatenate(found) if found else np.zeros((0, 3), dtype=np.int64)
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = x = root.get(root[x], root[x])
            return x

        links = []
        name = comps.tolist()
        for _, i, j in pairs[np.lexsort((pairs[:, 2], pairs[:, 1], pairs[:, 0]))].tolist():
            x, y = find(name[i]), find(name[j])
            if x != y and _similar(sets[i], sets[j], percent):
                root[max(x, y)] = min(x, y)
                links.append((int(ids[i]), int(ids[j])))
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return each


def _merged(components: DataFrame, links: DataFrame) -> DataFrame:
    """(id, comp) after the components that links join are one."""
    at = components.select(F.col("id").alias("b"), F.col("comp").alias("cb"))
    edges = links.join(components.select(F.col("id").alias("a"), F.col("comp").alias("ca")), "a").join(at, "b").select(F.col("ca").alias("src"), F.col("cb").alias("dst"))
    new = connected_components(edges).select(F.col("id").alias("comp"), "component")
    return save(components.join(new, "comp", "left").select("id", F.coalesce("component", "comp").alias("comp")), "comps")


def _tiled(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, cluster, tile): members of a cluster in the order of the hub that they share most keys with, cut by load."""
    each = shared.select("id", F.explode("keys").alias("key"))
    hubs = each.groupBy("key").agg(F.min("id").alias("hub"))
    votes = save(each.join(hubs, "key").groupBy("id", "hub").agg(F.count(F.lit(1)).alias("votes")), "votes")
    clusters = connected_components(votes.select(F.col("id").alias("src"), F.col("hub").alias("dst"))).withColumnRenamed("component", "cluster")
    anchor = votes.groupBy("id").agg(F.max_by("hub", F.struct("votes", -F.col("hub"))).alias("anchor"))
    load = classes.select("id", (F.col("n_shingles") + 2000).alias("load"))
    placed = clusters.join(anchor, "id").join(load, "id").select("id", "cluster", "anchor", "load")
    summed = running_total(placed, ["cluster"], [F.col("anchor"), F.col("id")], F.col("load"), "before")
    return save(summed.select("id", "cluster", F.floor(F.col("before") / TILE).cast("int").alias("tile")), "tiles")


def minhash_dedup(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    r"""A row for each row of ``docs``: doc_id, n_shingles, component_id, kept.

    Words are ``[^\x20\x09-\x0D]+`` with A-Z in lower case; a text of fewer
    words than a shingle is one shingle of them all; null texts and texts
    without words have none and link with nothing. Two documents are linked if
    100 * intersection >= percent * union of their shingle sets; component_id
    is the smallest id reachable by links and ``kept`` marks that document.
    Rows that repeat an id each get a row (their texts may count as linked), a
    null id is never linked and kept.
    An empty table gives an empty table.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = save(_signed(narrow, shingle_words), "signed")
    real = signed.where("n_shingles > 0 and id is not null")
    classes = save(real.groupBy("print").agg(F.min("id").alias("id"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles")), "classes")
    keys = _keys(classes)
    often = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    # a row for each document with the keys that it shares: later joins by document move no row for each key
    shared = save(keys.join(often, "key").groupBy("id").agg(F.collect_list("key").alias("keys")), "keys")
    tiles = _tiled(shared, classes)

    def make():
        shingler, multipliers = Shingler(shingle_words), _multipliers()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingler.sets(x) for x in as_bytes(batch.column(1))]
            signs = [signature(x, multipliers).tobytes() if len(x) else None for x in sets]
            return pa.record_batch([batch.column(0), pa.array(signs, pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], ["id", "signature", "shingles"])

        return each

    # full sets of those that share a key at all, from their texts once more
    inside = narrow.join(tiles.select("id").distinct(), "id", "left_semi")
    sets = save(map_batches(inside, make, "id long, signature binary, shingles binary").where("signature is not null"), "sets")

    def links(pairs: DataFrame, comps: DataFrame) -> DataFrame:
        """pairs: (cluster, t1, t2) with t1 <= t2."""
        ends = pairs.select("cluster", F.col("t1").alias("tile"), "t1", "t2").unionByName(pairs.where("t1 <> t2").select("cluster", F.col("t2").alias("tile"), "t1", "t2"))
        rows = ends.join(tiles.join(comps, "id"), ["cluster", "tile"]).join(sets, "id")
        return save(rows.select("cluster", "t1", "t2", "tile", "id", "comp", "signature", "shingles").groupBy("cluster", "t1", "t2").applyInArrow(_compare(percent), "a long, b long"), "links")

    each_tile = tiles.select("cluster", "tile").distinct()
    first = each_tile.select("cluster", F.col("tile").alias("t1"), F.col("tile").alias("t2")).unionByName(each_tile.where("tile > 0").select("cluster", F.lit(0).alias("t1"), F.col("tile").alias("t2")))
    comps = _merged(tiles.select("id", F.col("id").alias("comp")), links(first, tiles.select("id", F.col("id").alias("comp"))))
    large = tiles.where("tile > 1").select("cluster").distinct()
    inside = tiles.join(large, "cluster", "left_semi").join(comps, "id")
    at = shared.join(inside, "id").select("cluster", "tile", "comp", F.explode("keys").alias("key"))
    met = at.groupBy("key", "cluster", "tile").agg(F.min("comp").alias("least"), F.max("comp").alias("most"))
    met = save(met, "met")
    open_ = met.groupBy("key").agg(F.min("least").alias("a"), F.max("most").alias("b")).where("a <> b").select(F.col("key").alias("k"))
    met = save(met.join(open_, F.col("key") == F.col("k"), "left_semi"), "met")  # keys whose documents are all joined go before tiles meet
    x, y = met.select("key", "cluster", F.col("tile").alias("t1"), F.col("least").alias("l1"), F.col("most").alias("m1")), met.select("key", F.col("tile").alias("t2"), F.col("least").alias("l2"), F.col("most").alias("m2"))
    rest = save(x.join(y, "key").where("t1 < t2 and t1 > 0 and (l1 <> m2 or l2 <> m1)").select("cluster", "t1", "t2").distinct(), "rest")
    if not rest.isEmpty():
        comps = _merged(comps, links(rest, comps))
    # classes to components, and those back to every document of a class; documents without shingles or id stand for themselves and meet on no key
    found = classes.join(comps, "id", "left").select("print", F.coalesce("comp", "id").alias("component_id"))
    linked = signed.where("n_shingles > 0 and id is not null")
    alone = signed.where("not (n_shingles > 0 and id is not null)").select("id", "n_shingles", F.col("id").alias("component_id"))
    placed = linked.join(found, "print").select("id", "n_shingles", "component_id").unionByName(alone)
    return placed.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept"))
