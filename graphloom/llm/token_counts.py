"""Token counts of documents in flat token files that have no index.

Blocks of a file are searched for the end-of-document id with one vectorised
comparison each. A block cannot know how many documents began before it nor
where the open one started; a prefix scan over one small row a block (number
of separators, place of the last one) stitches them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.batches import bounded
from graphloom.llm.bpe import encoder
from graphloom.llm.token_files import filesystem
from graphloom.plans import fresh_path, save

BLOCK_BYTES = 8 << 20


def write_flat_files(docs: DataFrame, tokenizer: str, separator: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Encode whole texts into flat files of ids, each document closed by ``separator``, in the order they are read.

    Returns the files (path, n_bytes, width) and the order of documents in them
    (path, number, doc_id). Texts that spell a special token are plain text
    here, so the separator never comes from a text. Null text is empty.
    """
    spark = docs.sparkSession
    bounded(spark)
    folder = folder or fresh_path(spark, "flat")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, out, number, n_bytes, path = encoder(tokenizer, special_as_text=True), None, 0, 0, ""
        end = np.array([separator], dtype=bpe.dtype).tobytes()
        for batch in batches:
            if out is None:
                store, inner = filesystem(folder)
                store.create_dir(inner, recursive=True)
                name = f"{uuid.uuid4().hex}.ids"
                path, out = f"{folder}/{name}", store.open_output_stream(f"{inner}/{name}")
            for text in batch.column(1).to_pylist():
                n_bytes += out.write(bpe.encode(text or "") + end)
            n = batch.num_rows
            yield pa.record_batch([pa.array([path] * n), pa.array(range(number, number + n), pa.int64()), batch.column(0), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())], names)
            number += n
        if out is not None:
            out.close()
            yield pa.record_batch([pa.array([path]), pa.array([-1], pa.int64()), pa.nulls(1, pa.int64()), pa.array([n_bytes]), pa.array([bpe.dtype.itemsize], pa.int32())], names)

    names = ["path", "number", "doc_id", "n_bytes", "width"]
    rows = save(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "path string, number long, doc_id long, n_bytes long, width int"), "flat-order")
    return rows.where("number < 0").select("path", "n_bytes", "width"), rows.where("number >= 0").select("path", "number", "doc_id")


def token_counts(files: DataFrame, separator: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, number, start, n_tokens) of each document in flat files: number in the file, first id, ids without the separator.

    Ids after the last separator of a file are a document too, if there are
    any. An empty file has none; two separators in a row enclose a document of
    no tokens.
    """
    bounded(files.sparkSession)
    block = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("n_bytes") - 1) / block_bytes).cast("int"))))
    blocks = files.where("n_bytes > 0").select("path", "width", "n_bytes", block.alias("block"))
    n_blocks = max(1, blocks.count())
    blocks = blocks.repartition(min(n_blocks, 100_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, inner = filesystem(row["path"])
                begin = row["block"] * block_bytes
                size = min(block_bytes, row["n_bytes"] - begin)
                with store.open_input_file(inner) as file:
                    ids = np.frombuffer(file.read_at(size, begin), f"<u{row['width']}")
                at = np.flatnonzero(ids == separator) + begin // row["width"]
                if begin + size == row["n_bytes"] and len(ids) and ids[-1] != separator:
                    at = np.append(at, row["n_bytes"] // row["width"])  # the file ends inside a document
                yield pa.record_batch([pa.array([row["path"]]), pa.array([row["block"]], pa.int32()), pa.array([len(at)], pa.int64()), pa.array([int(at[-1]) if len(at) else None], pa.int64()), pa.array([at.tolist()], pa.list_(pa.int64()))], ["path", "block", "n", "last", "ends"])

    found = save(blocks.mapInArrow(run, "path string, block int, n long, last long, ends array<long>"), "separators")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scan = found.select("path", "block", "n", "last").select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), (F.coalesce(F.max("last").over(before), F.lit(-1)) + 1).alias("open"))
    each = found.where("n > 0").join(scan, ["path", "block"]).select("path", "base", "open", "ends", F.posexplode("ends").alias("k", "end"))
    start = F.when(F.col("k") == 0, F.col("open")).otherwise(F.get("ends", F.col("k") - 1) + 1)
    return each.select("path", (F.col("base") + F.col("k")).alias("number"), start.alias("start"), (F.col("end") - start).alias("n_tokens"))


def documents_token_counts(docs: DataFrame, tokenizer: str, separator: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Flat files of ``docs`` scanned, with the ids of the documents: doc_id, path, number, start, n_tokens.

    Null and empty texts have 0 tokens; repeated rows and null ids keep a row
    each; an empty table has none.
    """
    files, order = write_flat_files(docs, tokenizer, separator, None, id_col, text_col)
    return token_counts(files, separator).join(order, ["path", "number"]).select("doc_id", "path", "number", "start", "n_tokens")
