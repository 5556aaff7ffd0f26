"""Graphs with labels for vertices: a dictionary of ids in a folder that grows by batches and never changes an id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import Graph, from_edges
from graphloom.plans import running_total


class Labels:
    """(label, id) of all labels seen so far, in the batches of a folder.

    Ids count from 0 without gaps: the labels that a batch adds follow those
    before it and stand in the order of the labels. A batch is written as one
    job whose files count once it has committed, so a batch that failed is added
    again as a whole. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, label_type: str = "string") -> None:
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), f"label {label_type}, id bigint"

    def _batches(self) -> list[str]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [f.getPath() for f in files.listStatus(root)] if files.exists(root) else []
        done = [p for p in found if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(p.getName() for p in done)

    def table(self) -> DataFrame:
        """(label, id)"""
        batches = self._batches()
        if not batches:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/{b}" for b in batches))

    def add(self, labels: DataFrame) -> DataFrame:
        """Give ids to the labels (column ``label``) that have none; nulls are no labels. Returns the whole table."""
        known = self.table()
        new = labels.select("label").where("label is not null").distinct().join(known, "label", "left_anti")
        first = known.agg(F.coalesce(F.max("id") + 1, F.lit(0))).first()[0]
        ids = running_total(new.withColumn("_g", F.lit(0)), ["_g"], [F.col("label")], F.lit(1).cast("long"), "k")
        batch = f"{self.folder}/batch-{len(self._batches()):08d}"
        ids.select("label", (F.col("k") + first).cast("long").alias("id")).write.mode("overwrite").parquet(batch)
        return self.table()

    def ids_of(self, edges: DataFrame) -> DataFrame:
        """(src, dst, weight) in ids for edges between labels; edges with an unknown or null end are left out."""
        known = self.table()
        weight = F.col("weight") if "weight" in edges.columns else F.lit(1).cast("long")
        of = lambda c: known.select(F.col("label").alias(c), F.col("id").alias(f"_{c}"))
        both = edges.select("src", "dst", weight.alias("weight")).join(of("src"), "src").join(of("dst"), "dst")
        return both.select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), "weight")

    def graph(self, edges: DataFrame, directed: bool, combine: str = "max") -> Graph:
        """A graph whose vertices are all labels so far, as (id, data = label); labels of ``edges`` are added first."""
        self.add(edges.select(F.col("src").alias("label")).unionByName(edges.select(F.col("dst").alias("label"))))
        g = from_edges(self.ids_of(edges), directed, combine)
        return Graph(self.table().select("id", F.col("label").alias("data")), g.edges, directed)
