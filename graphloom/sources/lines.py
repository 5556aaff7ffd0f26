"""Text files as numbered lines, read in splits.

A line's place is (file, start of its split, number within the task), which
orders the lines of a file without reading it in one piece. Section headers
are few; each line finds the last header before it by comparing places with
them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, line); place orders the lines of a file."""
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))
    return text.select("file", F.struct("block", "n").alias("place"), "line")


def sectioned(text: DataFrame, header: Column) -> DataFrame:
    """Add ``header`` and ``header_place`` of the last header line at or before each line (null before the first)."""
    heads = text.where(header).groupBy("file").agg(F.sort_array(F.collect_list(F.struct("place", "line"))).alias("heads"))  # a few lines a file
    before = F.filter("heads", lambda h: h["place"] <= F.col("place"))
    last = F.try_element_at(before, F.lit(-1))
    return text.join(F.broadcast(heads), "file", "left").select("file", "place", "line", last["line"].alias("header"), last["place"].alias("header_place"), (last["place"] == F.col("place")).alias("is_header"))

