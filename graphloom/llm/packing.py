"""Packing into length buckets that minimise padding.

The histogram of lengths is global and of bounded size: lengths under 4096 are
exact, longer ones share cells of 1/2048 of their size. A dynamic program over
its cells finds the bucket ends with the least padding in all; ends above 4096
are the longest lengths of cells, so a bucket may end up to 1/2048 of its length
away from the very best place, and that is all the padding lost by the cells. A
bucket's documents are ranked across partitions and cut into batches of a token
budget.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.batches import map_batches, n_words, of_doc, row_hashes, whole_rows
from graphloom.llm.bpe import encoder
from graphloom.plans import running_total, save

EXACT = 4096


def cell_of(length: Column) -> Column:
    """Cell of the histogram: the length itself, or its upper end on a grid of 2048 steps a doubling."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(length, F.lit(EXACT)).cast("double"))) - 11).cast("long")
    return F.when(length <= EXACT, length).otherwise((F.ceil(length / step) * step).cast("long")).cast("long")


def bucket_ends(lengths: np.ndarray, n: np.ndarray, total: np.ndarray, buckets: int) -> list[int]:
    """Ends of at most ``buckets`` buckets with the least padding.

    lengths: ascending longest length of each cell; n, total: documents and sum
    of lengths in it. Padding of cells i+1..j in one bucket is
    lengths[j] * (N[j] - N[i]) - (S[j] - S[i]); for fixed i a line in
    lengths[j], so each layer of the program is a lower hull of lines that is
    walked once.
    """
    if not len(lengths):
        return []
    N, S = np.concatenate([[0], np.cumsum(n)]).tolist(), np.concatenate([[0], np.cumsum(total)]).tolist()
    L, m = [0, *lengths.tolist()], len(lengths)
    best = [0] + [L[j] * N[j] - S[j] for j in range(1, m + 1)]
    cuts: list[list[int]] = [[0] * (m + 1)]
    for _ in range(1, min(buckets, m)):
        hull: list[tuple[int, int, int]] = []  # slope -N[i], intercept best[i] + S[i], i
        at, new, cut = 0, [0] * (m + 1), [0] * (m + 1)
        for j in range(1, m + 1):
            i = j - 1
            line = (-N[i], best[i] + S[i], i)
            while len(hull) >= 2 and (line[1] - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - line[0]):
                hull.pop()
            hull.append(line)
            at = min(at, len(hull) - 1)
            while at + 1 < len(hull) and hull[at + 1][0] * L[j] + hull[at + 1][1] <= hull[at][0] * L[j] + hull[at][1]:
                at += 1
            slope, base, i = hull[at]
            new[j], cut[j] = slope * L[j] + base + L[j] * N[j] - S[j], i
        best, _ = new, cuts.append(cut)
    ends, j = [], m
    for cut in reversed(cuts):
        if j == 0:
            break
        ends.append(L[j])
        j = cut[j]
    return sorted(set(ends))


def tokens_for_text(rows: DataFrame, tokenizer: str) -> DataFrame:
    """``rows`` with ``length``, the number of ids that token files hold for it, in place of its column ``text``; null text has none."""

    def make():
        bpe = encoder(tokenizer)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = [len(bpe.encode(x)) // bpe.dtype.itemsize if x else 0 for x in batch.column("text").to_pylist()]
            return pa.record_batch([*(batch.column(c) for c in kept), pa.array(n, pa.int64())], [*kept, "length"])

        return each

    kept = [c for c in rows.columns if c != "text"]
    return map_batches(rows, make, T.StructType([*(T.StructField(c, rows.schema[c].dataType) for c in kept), T.StructField("length", T.LongType())]))


def pack(docs: DataFrame, buckets: int = 16, budget: int = 16_384, length: Column | None = None, order: Column | None = None, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """A row for each row of ``docs``: id, row, row2, length, bucket, bucket_length, batch, slot.

    ``row`` and ``row2``, hashes of all columns, tell rows of one id apart. Each
    batch holds up to max(1, budget // bucket_length) documents of one bucket,
    in the order of ``order`` (default: a hash of the row), and only a
    bucket's last batch may be short. A document longer than the budget is a
    batch of its own; nothing is cut or dropped. Length is an expression if one
    is given, else the number of tokens by the vocabulary file ``tokenizer``,
    else the number of words; null lengths count as 0. Documents of length 0
    fall into the first bucket. An empty table has no rows.
    """
    row, row2 = row_hashes(docs)
    narrow = [F.col(id_col).alias("id"), row, row2, (order if order is not None else row).alias("ord")]
    if length is None and tokenizer:
        rows = save(tokens_for_text(docs.select(*narrow, F.col(text_col).alias("text")), tokenizer), "lengths")  # encoded once, read twice
    else:
        length = F.greatest(F.coalesce(length if length is not None else n_words(text_col), F.lit(0)), F.lit(0)).cast("long")
        rows = docs.select(*narrow, length.alias("length"))
    hist = rows.groupBy(cell_of(F.col("length")).alias("cell")).agg(F.max("length").alias("most"), F.count(F.lit(1)).alias("n"), F.sum("length").alias("total")).orderBy("most").collect()  # of bounded size
    ends = bucket_ends(*(np.array([r[c] for r in hist], dtype=np.int64) for c in ("most", "n", "total")), buckets)
    if not ends:
        return rows.select("id", "row", "row2", "length", *(F.lit(0).cast("long").alias(c) for c in ("bucket", "bucket_length", "batch", "slot"))).limit(0)
    bucket = sum(((F.col("length") > e).cast("long") for e in ends[:-1]), F.lit(0).cast("long"))
    placed = rows.withColumn("bucket", bucket)
    ranked = running_total(placed, ["bucket"], [F.col("ord"), F.col("row"), F.col("row2")], F.lit(1).cast("long"), "rank")
    of = F.element_at(F.array(*(F.lit(e).cast("long") for e in ends)), (F.col("bucket") + 1).cast("int"))
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), F.col("bucket_length")))).cast("long")
    return ranked.withColumn("bucket_length", of).select("id", "row", "row2", "length", "bucket", "bucket_length", F.floor(F.col("rank") / room).cast("long").alias("batch"), (F.col("rank") % room).alias("slot"))


def pack_documents(docs: DataFrame, buckets: int = 16, budget: int = 16_384, length: Column | None = None, order: Column | None = None, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``pack`` with all columns of ``docs`` beside the place: length, bucket, bucket_length, batch, slot.

    Columns of ``docs`` with these names are replaced. Rows that are equal in
    all columns keep a place each, and so a row each. Columns may be maps,
    structs and arrays of any kind.
    """
    new = ["length", "bucket", "bucket_length", "batch", "slot"]
    packed = pack(docs, buckets, budget, length, order, id_col, text_col, tokenizer).drop("id")
    kept = [c for c in docs.columns if c.lower() not in new]
    return packed.join(whole_rows(docs), ["row", "row2"]).select(*of_doc(docs, kept), *new)
