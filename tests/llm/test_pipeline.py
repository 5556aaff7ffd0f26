"""The pipeline's stages against brute force, and its order of batches against the schedule."""

from collections import Counter

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.plans import save

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COMMON = "this line stands in very many documents"


def fixture():
    """Clean texts of three sources, toxic ones, a line that all share, and exact copies."""
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abdefghiklmnoprstu"), rng.integers(3, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        w = list(rng.choice(words, rng.integers(8, 60)))
        if toxic := int(i % 4 == 3):
            w[2:2] = ["vexzoq", "quibjax", "vexzoq"]
        rows.append((i, " ".join(w) + ("\n" + COMMON if i % 2 else ""), "en", "abc"[i % 3], toxic))
        labels.append((i, 1, toxic))
    rows += [(1000 + i, rows[4 * i][1], "en", "b", 0) for i in range(20)]
    return [(*r[:4], len(r[1]), r[4]) for r in rows], labels


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rows, labels = fixture()
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([r[:5] for r in rows], SCHEMA).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir).collect()
    stays = {r[0]: (r[1].split("\n")[0], r[3]) for r in fixture()[0] if not r[5] and r[0] < 1000}  # no toxic text, no common line, no copy
    copies, batches = Counter(r["doc_id"] for r in out), {}
    for r in out:
        assert (r["text"], r["source"], r["n_chars"]) == (*stays[r["doc_id"]], len(r["text"]))
        batches.setdefault((r["bucket"], r["batch"]), []).append(r)
    taken = Counter((stays[i][1], len(stays[i][0].split()), copies[i]) for i in stays)
    assert taken == plain.copies([(s, len(t.split())) for t, s in stays.values()], lambda i: (5.0, 2.0, 1.0)[i % 3])
    for members in batches.values():
        assert sorted(m["slot"] for m in members) == list(range(len(members)))
        assert len(members) == 1 or len(members) * members[0]["bucket_length"] <= 16_384
        assert all(m["length"] <= m["bucket_length"] for m in members)


def test_batches_follow_the_schedule(spark):
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.concat(F.lit("word " * 200), "id").alias("text"), F.lit("en").alias("lang"), F.element_at(F.array(*map(F.lit, "abc")), (F.col("id") % 3 + 1).cast("int")).alias("source"), F.lit(9).cast("long").alias("n_chars"))
    mixed = save(corpus_pipeline.mixed(spark, docs, ""), "mixed")
    want = [r["doc_id"] for r in mixed.select("doc_id", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i")).orderBy("f", "i").collect()]
    out = sorted(corpus_pipeline.packed(spark, mixed, "").collect(), key=lambda r: (r["bucket"], r["batch"], r["slot"]))
    for bucket in {r["bucket"] for r in out}:
        mine = [r["doc_id"] for r in out if r["bucket"] == bucket]
        assert mine == [i for i in want if i in set(mine)]
    # source a fades out, c comes late
    ends = {r["bucket"]: r["batch"] for r in out}
    when = {s: np.mean([r["batch"] / max(1, ends[r["bucket"]]) for r in out if r["source"] == s]) for s in "abc"}
    assert when["a"] < 0.48 < 0.55 < when["c"]
