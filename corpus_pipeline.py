"""From raw documents to packed training batches, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one
before it kept; all but the last return the columns of ``documents``. A null
text counts as an empty one and becomes "" in the second stage. Empty texts are
clean, have no lines to lose and no near copies, and end at the mixing stage,
which takes words. Rows without an id stay; rows that repeat an id and a text
are one row from the third stage on. Ties of near copies go to the smallest id.
An empty table gives an empty table. Columns beside those of ``documents`` pass
through, whatever their names; n_chars follows the text, and the last stage
replaces columns of the names that it adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import mixing, packing, toxicity
from graphloom.llm.line_dedup import line_dedup
from graphloom.llm.minhash import minhash_dedup
from graphloom.llm.queries import CURRICULUM, TOKENIZER
from graphloom.plans import save


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where("predicted = 0").select(*docs.columns)


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more of them share; n_chars follows the text."""
    return line_dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id."""
    kept = minhash_dedup(docs, shingle_words=5, percent=80).where("kept").select(F.col("doc_id").alias("id")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("print"))
    stay = rows.join(kept, rows["id"].eqNullSafe(kept["id"]), "left_semi").dropDuplicates(["id", "print"])
    return stay.select(*(F.col(f"doc.{c}") for c in docs.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the curriculum takes them, in training order: by range over the files, sorted within each."""
    return mixing.mix(docs, CURRICULUM).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its place in a batch; the batches of a bucket follow the order of the rows of ``docs``, a table read from files."""
    place = F.struct("_metadata.file_name", "_metadata.row_index")
    return packing.pack_documents(docs, order=place, tokenizer=TOKENIZER)


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_common_lines),
    ("near-copies", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: The first stage is a trained classifier, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *first, (_, last) = STAGES
    for name, stage in first:
        docs = save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return last(spark, docs, sf_dir)
