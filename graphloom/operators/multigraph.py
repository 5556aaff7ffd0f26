"""Multigraphs: edges (edge_id, src, dst, data), parallel edges and loops allowed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph, from_edges


@dataclass(frozen=True)
class MultiGraph:
    vertices: DataFrame
    edges: DataFrame
    directed: bool

    def to_simple(self, combine: str = "min") -> Graph:
        """Parallel edges become one; ``combine``: min, max, sum, count..."""
        return from_edges(self.edges.select("src", "dst", F.col("data").alias("weight")), self.directed, combine, self.vertices)

    def degrees(self) -> DataFrame:
        """(id, degree): a loop of an undirected graph counts two; in + out for directed ones."""
        ends = self.edges.select(F.col("src").alias("id")).unionByName(self.edges.select(F.col("dst").alias("id")))
        return self.vertices.select("id").join(ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree")), "id", "left").na.fill(0, ["degree"])

    def parallel(self) -> DataFrame:
        """(src, dst, n_edges) of pairs with several edges."""
        ends = (F.col("src"), F.col("dst")) if self.directed else (F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        return self.edges.groupBy(*ends).agg(F.count(F.lit(1)).alias("n_edges")).where("n_edges > 1")

    def filter_edges(self, keep: Column) -> MultiGraph:
        return MultiGraph(self.vertices, self.edges.where(keep), self.directed)


def from_rows(edges: DataFrame, directed: bool, order: list[Column]) -> MultiGraph:
    """Number the rows of (src, dst, data) 0, 1, ... in ``order``."""
    from graphloom.plans import running_total

    numbered = running_total(edges.withColumn("g", F.lit(0)), ["g"], order, F.lit(1).cast("long"), "edge_id").drop("g")
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return MultiGraph(ends, numbered.select("edge_id", "src", "dst", "data"), directed)
