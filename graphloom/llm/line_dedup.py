"""Line dedup with a sharded minimal perfect hash.

1. Every document names its distinct line keys; counts of documents per line
   hash are combined in each Arrow batch and again before the shuffle.
2. Line hashes are dealt to shards. A shard's minimal perfect hash points each
   of its hashes to a slot of two compact arrays: a 32-bit fingerprint and a
   document count that saturates at the threshold in one to eight bytes.
3. Documents probe: a (document, line hash) goes to its line's shard, where
   one vectorised lookup answers it. Shards that more documents probe (a line
   in a third of all rows) are copied to as many tasks as their probe count
   asks for, and probes are dealt over the copies. Lines are never joined
   with lines, and only hits travel back.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.batches import SPACE, as_bytes, map_batches, without
from graphloom.llm.mphf import Lookup, build
from graphloom.plans import save, shuffle_partitions

#: Keys of a shard that one task builds at once, and shards whose probe counts the driver reads at most.
SHARD_KEYS, MOST_SHARDS = 1 << 20, 1 << 16
_ARRAYS = "shard int, probes long, levels array<binary>, fingerprints binary, counts binary, clashes binary"


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()


def _keys(text: bytes, least: int) -> set[bytes]:
    found = {line_key(x) for x in text.split(b"\n")}
    return {x for x in found if len(x) >= least and (least < 2 or len(x.decode()) >= least)}


def _hashes(keys: list[bytes]) -> np.ndarray:
    """Two uint64 a key: the first one chooses shard and slot, the second is the fingerprint."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), dtype="<u8").reshape(-1, 2)


def _counts(docs: DataFrame, least: int) -> DataFrame:
    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            seen: Counter[bytes] = Counter()
            for text in as_bytes(batch.column(0)):
                seen.update(_keys(text, least))
            h = _hashes(list(seen))
            return pa.record_batch([pa.array(h[:, 0].view(np.int64)), pa.array(h[:, 1].view(np.int64)), pa.array(list(seen.values()), pa.int64())], ["h1", "h2", "n"])

        return each

    return map_batches(docs.select("text"), make, "h1 long, h2 long, n long").groupBy("h1", "h2").agg(F.sum("n").alias("n"))


def _shard(h1: np.ndarray, shards: int) -> np.ndarray:
    return ((h1 >> np.uint64(33)) % np.uint64(shards)).astype(np.int32)


def _build(min_docs: int):
    small = np.min_scalar_type(min_docs)

    def each(key: tuple, group: pa.Table) -> pa.Table:
        h1, h2 = (group[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
        n = group["n"].to_numpy()
        most = np.minimum(n, min_docs).astype(small)
        order = np.argsort(h1, kind="stable")
        same = np.zeros(len(h1), dtype=bool)  # two lines with one h1: kept aside with both hashes
        twin = h1[order][1:] == h1[order][:-1]
        same[order[1:]] |= twin
        same[order[:-1]] |= twin
        levels = build(h1[~same])
        slot = Lookup(levels).index(h1[~same])
        prints, counts = np.zeros(len(slot), dtype="<u4"), np.zeros(len(slot), dtype=small)
        prints[slot], counts[slot] = h2[~same].astype("<u4"), most[~same]
        aside = np.stack([h1[same], h2[same], most[same].astype(np.uint64)], axis=1).astype("<u8")
        row = [key[0].as_py(), int(n.sum()), levels, prints.tobytes(), counts.tobytes(), aside.tobytes()]
        types = [pa.int32(), pa.int64(), pa.list_(pa.binary()), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=["shard", "probes", "levels", "fingerprints", "counts", "clashes"])

    return each


def _probe(min_docs: int):
    small = np.min_scalar_type(min_docs)

    def each(probes: pa.Table, arrays: pa.Table) -> pa.Table:
        hit = np.zeros(len(probes), dtype=bool)
        if len(probes) and len(arrays):
            row = arrays.slice(0, 1).to_pylist()[0]
            h1, h2 = (probes[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
            slot = Lookup(row["levels"]).index(h1)
            prints, counts = np.frombuffer(row["fingerprints"], dtype="<u4"), np.frombuffer(row["counts"], dtype=small)
            if len(prints):
                hit = (slot >= 0) & (prints[slot] == h2.astype("<u4")) & (counts[slot] >= min_docs)
            if row["clashes"]:
                often = {(a, b) for a, b, n in np.frombuffer(row["clashes"], dtype="<u8").reshape(-1, 3).tolist() if n >= min_docs}
                clash = np.flatnonzero(np.isin(h1, np.frombuffer(row["clashes"], dtype="<u8")[::3]))
                hit[clash] = [(int(h1[i]), int(h2[i])) in often for i in clash]
        return probes.filter(pa.array(hit)).select(["doc", "print", "h1", "h2"])

    return each


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    r"""Drop every line whose key is found in at least ``min_docs`` documents; add ``n_lines`` and ``n_dropped``.

    A key is the line without white space (``[\x20\x09-\x0D]``) at its ends and
    with A-Z in lower case; keys shorter than ``min_chars`` code points always
    stay. Null text counts as empty: one empty line, and becomes "". Each row
    is a document, so repeated rows count each; a null or repeated id is fine.
    A document may lose all lines; its row stays. Columns named n_lines or
    n_dropped are replaced, all others pass through. An empty table gives an
    empty table. Lines are told apart by 128-bit hashes.
    """
    spark = docs.sparkSession
    kept = without(docs, "n_lines", "n_dropped")
    narrow = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("print"))
    counts = save(_counts(narrow, min_chars), "line-counts")
    distinct, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = min(max(shuffle_partitions(spark), math.ceil(distinct / SHARD_KEYS)), MOST_SHARDS)
    dealt = counts.withColumn("shard", (F.shiftrightunsigned("h1", 33) % shards).cast("int"))
    arrays = save(dealt.groupBy("shard").applyInArrow(_build(min_docs), _ARRAYS), "line-arrays")
    # copies of a shard: one for each load of twice the mean; at most half as many more rows than shards in all
    load = max(1.0, 2.0 * total / shards)
    copies = F.ceil(F.col("probes") / F.lit(load)).cast("int")
    hot = {r["shard"]: r["n"] for r in arrays.select("shard", copies.alias("n")).where("n > 1").collect()}

    def make():
        n_copies = np.ones(shards, dtype=np.int64)
        n_copies[list(hot)] = list(hot.values())
        turn = 0

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal turn
            found = [list(_keys(x, min_chars)) for x in as_bytes(batch.column(1))]
            h = _hashes([x for keys in found for x in keys])
            row = np.repeat(np.arange(len(found)), list(map(len, found)))
            shard = _shard(h[:, 0], shards)
            copy = ((row + turn) % n_copies[shard]).astype(np.int32)
            turn += len(found)
            return pa.record_batch([pa.array(shard), pa.array(copy), batch["doc"].take(pa.array(row)), batch["print"].take(pa.array(row)), pa.array(h[:, 0].view(np.int64)), pa.array(h[:, 1].view(np.int64))], ["shard", "copy", "doc", "print", "h1", "h2"])

        return each

    id_type = docs.schema[id_col].dataType.simpleString()
    probes = map_batches(narrow, make, f"shard int, copy int, doc {id_type}, print long, h1 long, h2 long")
    spread = arrays.withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    hits = probes.groupBy("shard", "copy").cogroup(spread.groupBy("shard", "copy")).applyInArrow(_probe(min_docs), f"doc {id_type}, print long, h1 long, h2 long")
    # hits go back to the rows of their id and text, so rows without an id and rows that repeat one stay apart
    by_doc = hits.groupBy("doc", "print").agg(F.collect_set(F.struct("h1", "h2")).alias("hits"))
    rows = kept.select(F.struct(*(F.col(f"`{c}`") for c in kept.columns)).alias("row"), F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("print"))
    both = rows.join(by_doc, (rows["print"] == by_doc["print"]) & rows["doc"].eqNullSafe(by_doc["doc"]), "left").select("row", "hits")
    at = kept.columns.index(text_col)

    def rewrite():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns, hits = batch.column(0).flatten(), batch.column(1)
            out, n_lines, n_dropped = [], [], []
            for text, hit in zip(as_bytes(columns[at]), hits.to_pylist(), strict=True):
                lines = text.split(b"\n")
                n = len(lines)
                if hit:
                    gone = {np.array([x["h1"], x["h2"]], dtype=np.int64).tobytes() for x in hit}
                    keys = list(map(line_key, lines))
                    lines = [x for x, k in zip(lines, keys, strict=True) if not k or xxhash.xxh3_128_digest(k) not in gone]
                out.append(b"\n".join(lines))
                n_lines.append(n)
                n_dropped.append(n - len(lines))
            columns[at] = pa.array(out, pa.binary()).cast(columns[at].type)
            return pa.record_batch([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*names, "n_lines", "n_dropped"])

        return each

    names, fields = kept.columns, [T.StructField(f.name, f.dataType) for f in kept.schema]
    schema = T.StructType([*fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return map_batches(both, rewrite, schema)
