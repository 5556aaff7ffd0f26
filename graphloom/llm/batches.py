"""Shared small parts: Arrow batches of bounded size, ASCII white space, word counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.plans import ship

#: The white space of all text contracts: space and U+0009 to U+000D, which is also what bytes.split() and bytes.strip() take.
SPACE = b" \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"
BATCH_BYTES = 16 << 20


def bounded(spark: SparkSession) -> None:
    """Cap the bytes of an Arrow batch, so that long documents do not gather in a Python worker; have the package there."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow with a function per batch; ``make`` runs once in each task, for its state."""
    bounded(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            if batch.num_rows and (out := each(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def n_words(text: str | Column) -> Column:
    """Number of words, null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that would clash with an operator's results, whatever their case."""
    taken = {x.lower() for x in names}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in taken))


def _has_map(kind: T.DataType) -> bool:
    inner = [f.dataType for f in kind.fields] if isinstance(kind, T.StructType) else [kind.elementType] if isinstance(kind, T.ArrayType) else []
    return isinstance(kind, T.MapType) or any(map(_has_map, inner))


def _flat(c: Column, kind: T.DataType) -> Column:
    """``c`` with its maps as entries in order, which can be hashed and compared; equal maps give equal entries."""
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(c), lambda e: F.struct(_flat(e["key"], kind.keyType).alias("key"), _flat(e["value"], kind.valueType).alias("value")))
        return F.array_sort(entries)
    if isinstance(kind, T.ArrayType) and _has_map(kind):
        return F.transform(c, lambda x: _flat(x, kind.elementType))
    if isinstance(kind, T.StructType) and _has_map(kind):
        return F.when(c.isNotNull(), F.struct(*(_flat(c[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    return c


def row_hashes(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes of all columns, which name a row up to rows that are equal; of maps the entries count, not their order."""
    columns = [_flat(F.col(f"`{f.name}`"), f.dataType) for f in df.schema]
    return [F.xxhash64(*columns).alias("row"), F.xxhash64(F.lit(1), *columns).alias("row2")]


def whole_rows(df: DataFrame) -> DataFrame:
    """(row, row2, doc): each distinct row once as a struct, so that no column name of its own is in the way."""
    return df.select(*row_hashes(df), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("doc")).dropDuplicates(["row", "row2"])


def of_doc(df: DataFrame, columns: list[str]) -> list[Column]:
    return [F.col("doc").getField(c).alias(c) for c in columns]
