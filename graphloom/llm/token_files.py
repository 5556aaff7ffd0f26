"""Token-id files with Elias-Fano document boundaries.

A file is: the ids of its documents one after the other (two or four bytes
each, little-endian), the Elias-Fano codes of the documents' ends and of their
ascending document ids (less the smallest; documents without an id come first
and are only counted), a JSON footer with the places of these parts, the
footer's length in eight bytes, and eight magic bytes. Files hold about
FILE_BYTES of text and follow each other in ascending document order; each is
written by one task under a name of its own attempt, and only the manifest says
which files count, so tasks can be lost and rerun. They are read in ranges of
documents, whose places select finds.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.batches import bounded
from graphloom.llm.bpe import encoder
from graphloom.llm.elias_fano import Reader, encode
from graphloom.plans import fresh_path, save, shuffle_partitions

MAGIC = b"GLTOKEF1"
END_ID = 2
#: Text that a file holds, about; documents that a task reads at a time, and ids of a block.
FILE_BYTES, READ_DOCS, READ_IDS = 256 << 20, 1 << 16, 4 << 20


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    found, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return found, inner


class Writer:
    """One file: documents are added in order, ids go out at once, only their ends stay in memory."""

    def __init__(self, folder: str, dtype: np.dtype) -> None:
        self.store, inner = filesystem(folder)
        self.store.create_dir(inner, recursive=True)
        self.name = f"{uuid.uuid4().hex}.tok"
        self.out, self.dtype = self.store.open_output_stream(f"{inner}/{self.name}"), dtype
        self.ends, self.ids, self.at = [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.out.write(ids)
        self.at += len(ids) // self.dtype.itemsize
        self.ends.append(self.at)
        self.ids.append(doc_id)

    def close(self) -> None:
        known = [x for x in self.ids if x is not None]
        base = known[0] if known else 0
        ends, names = encode(np.array(self.ends, dtype=np.uint64)), encode(np.array([x - base for x in known], dtype=np.uint64))
        parts = {f"{kind}_{c}": code[c] for kind, code in (("ends", ends), ("ids", names)) for c in ("low", "high", "samples")}
        footer = {"n": len(self.ids), "nulls": len(self.ids) - len(known), "base": base, "dtype": self.dtype.str, "tokens": self.at, "parts": {}}
        footer |= {kind: {c: code[c] for c in ("n", "low_bits", "wide")} for kind, code in (("ends", ends), ("ids", names))}
        place = self.at * self.dtype.itemsize
        for name, data in parts.items():
            self.out.write(data)
            footer["parts"][name] = [place, len(data)]
            place += len(data)
        last = json.dumps(footer).encode()
        self.out.write(last + len(last).to_bytes(8, "little") + MAGIC)
        self.out.close()


class TokenFile:
    """Random access to the documents of one file."""

    def __init__(self, path: str) -> None:
        store, inner = filesystem(path)
        self.file = store.open_input_file(inner)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"not a token file: {path}")
        length = int.from_bytes(tail[:8], "little")
        self.footer = json.loads(self.file.read_at(length, size - 16 - length))
        part = {k: self.file.read_at(n, at) if n else b"" for k, (at, n) in self.footer["parts"].items()}
        self.n, self.dtype = self.footer["n"], np.dtype(self.footer["dtype"])
        self.ends, self.names = (Reader(low=part[f"{k}_low"], high=part[f"{k}_high"], samples=part[f"{k}_samples"], **self.footer[k]) for k in ("ends", "ids"))

    def doc_ids(self, start: int, stop: int) -> list[int | None]:
        """Document ids of documents start to stop - 1."""
        nulls = self.footer["nulls"]
        found = self.names.range(max(0, start - nulls), max(0, stop - nulls)).tolist()
        return [None] * max(0, min(stop, nulls) - start) + [(self.footer["base"] + x + 2**63) % 2**64 - 2**63 for x in found]

    def ids(self, start: int, stop: int) -> np.ndarray:
        w = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((stop - start) * w, start * w), self.dtype)

    def document(self, i: int) -> np.ndarray:
        """Ids of document i, its place found by select."""
        return self.ids(self.ends.select(i - 1) if i else 0, self.ends.select(i))

    def documents(self, first: int = 0, last: int | None = None) -> Iterator[tuple[int, int, np.ndarray]]:
        """(number, start, ids) of documents first to last - 1, in blocks of about READ_IDS ids."""
        i, last = first, self.n if last is None else min(last, self.n)
        start = self.ends.select(first - 1) if 0 < first < last else 0
        while i < last:
            ends = self.ends.range(i, min(i + 1024, last))
            take = max(1, int(np.searchsorted(ends, start + READ_IDS, side="right")))
            block = self.ids(start, int(ends[take - 1]))
            at = 0
            for k in range(take):
                n = int(ends[k]) - start - at
                yield i + k, start + at, block[at : at + n]
                at += n
            i, start = i + take, start + at


def write_token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Encode every whole text and write the files in ascending order of ``id_col``; returns the manifest.

    The manifest has a row for each file: part, path, n_docs, n_tokens, and
    start, the number of ids in the files before it. Null text is encoded as
    empty text, so that its document is the end id alone; a null id sorts
    first; rows with the same id each stay, in the order of their text. An
    empty table gives an empty manifest. Other columns are not read.
    """
    spark = docs.sparkSession
    bounded(spark)
    folder = folder or fresh_path(spark, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer)
        end, writer, part = np.array([end_id], dtype=bpe.dtype).tobytes(), None, None
        for batch in batches:
            for doc_id, text, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                writer = writer or Writer(folder, bpe.dtype)
                writer.add(doc_id, bpe.encode(text or "") + end)
        if writer:
            writer.close()
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([f"{folder}/{writer.name}"]), pa.array([len(writer.ids)], pa.int64()), pa.array([writer.at], pa.int64())], ["part", "path", "n_docs", "n_tokens"])

    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_files = partitions or max(shuffle_partitions(spark), -(-size // FILE_BYTES))
    dealt = narrow.repartitionByRange(n_files, *order).sortWithinPartitions(*order, F.col("text"))
    files = save(dealt.withColumn("part", F.spark_partition_id()).mapInArrow(run, "part int, path string, n_docs long, n_tokens long"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """A row for each document of the files: part, number, doc_id, start (over all files), n_tokens, ids_crc32."""
    bounded(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.to_pylist():
                found, rows = TokenFile(file["path"]), []
                names = found.doc_ids(file["first"], min(file["first"] + READ_DOCS, found.n))
                for i, start, ids in found.documents(file["first"], file["first"] + READ_DOCS):
                    rows.append((file["part"], i, names[i - file["first"]], file["start"] + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.int64()] * 5), strict=True)], ["part", "number", "doc_id", "start", "n_tokens", "ids_crc32"])

    schema = "part int, number long, doc_id long, start long, n_tokens long, ids_crc32 long"
    ranges = manifest.where("n_docs > 0").select("part", "path", "start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_docs") - 1, F.lit(READ_DOCS).cast("long"))).alias("first"))
    return ranges.repartition(shuffle_partitions(spark)).mapInArrow(run, schema)
