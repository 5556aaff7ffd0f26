"""Mixing and packing of tables with map, struct and array columns, which Spark neither hashes nor compares by itself."""

import pytest
from pyspark.sql import functions as F

from graphloom.llm import mixing, packing
from graphloom.llm.batches import row_hashes

SCHEMA = "doc_id long, text string, source string, meta map<string,int>, deep struct<a:array<map<string,array<int>>>,b:int>, tags array<string>"


def rows():
    out = [(i, f"word {i} " * (i % 7), "web" if i % 2 else None, {"a": i, "b": None}, ([{"x": [i]}, None], i), ["t", None]) for i in range(40)]
    return out + [(1, "same text", "web", None, None, None), (1, "same text", "web", {}, (None, 1), []), (1, "same text", "web", {}, (None, 1), [])]


def test_equal_maps_hash_alike(spark):
    one = spark.sql("select map('a', 1, 'b', 2) as m, named_struct('n', map(1, map('x', 'y'))) as s")
    two = spark.sql("select map('b', 2, 'a', 1) as m, named_struct('n', map(1, map('x', 'y'))) as s")
    odd = spark.sql("select map('b', 1, 'a', 2) as m, named_struct('n', map(1, map('x', 'y'))) as s")
    a, b, c = (tuple(df.select(*row_hashes(df)).first()) for df in (one, two, odd))
    assert a == b != c


@pytest.mark.parametrize("empty", [False, True])
def test_pack_and_mix(spark, empty):
    docs = spark.createDataFrame([] if empty else rows(), SCHEMA)
    packed = packing.pack_documents(docs, 3, 20)
    assert packed.columns[: len(docs.columns)] == docs.columns
    as_text = lambda df: sorted(r[0] for r in df.select(F.to_json(F.struct(*docs.columns))).collect())
    assert as_text(packed) == as_text(docs)
    mixed = mixing.mix(docs, mixing.repeating([1.0, 1.0]))
    assert set(as_text(mixed)) <= set(as_text(docs)) and (empty or mixed.count() > 0)
