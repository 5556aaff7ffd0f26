"""A graph is two DataFrames: vertices (id, data...) and edges (src, dst, weight)."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    """A simple graph. Undirected edges are stored once, with src <= dst.

    A null weight means unweighted and counts as 1 wherever a number is needed.
    """

    vertices: DataFrame
    edges: DataFrame
    directed: bool

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    def arcs(self) -> DataFrame:
        """(src, dst, weight) along which one can move: undirected edges both ways, loops once."""
        edges = self.edges.select("src", "dst", F.coalesce("weight", F.lit(1)).alias("weight"))
        if self.directed:
            return edges
        return edges.unionByName(edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))

    def both_ways(self) -> DataFrame:
        """Arcs without regard to direction; where a pair has both, the outgoing weight counts."""
        out = self.arcs()
        if not self.directed:
            return out
        back = out.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
        return out.unionByName(back.join(out, ["src", "dst"], "left_anti"))

    def with_edges(self, edges: DataFrame, directed: bool | None = None) -> Graph:
        return replace(self, edges=edges, directed=self.directed if directed is None else directed)


def canonical(edges: DataFrame) -> DataFrame:
    """Edges of an undirected graph with their smaller end first."""
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight")


def from_edges(edges: DataFrame, directed: bool, combine: str = "max", vertices: DataFrame | None = None) -> Graph:
    """A simple graph; parallel edges become one by ``combine`` (min, max, sum, first or any aggregate function of Spark).

    Edges with a null end are dropped. Without ``vertices`` the ends make them.
    """
    if "weight" not in edges.columns:
        edges = edges.withColumn("weight", F.lit(1).cast("long"))
    edges = edges.select("src", "dst", "weight").where("src is not null and dst is not null")
    edges = edges if directed else canonical(edges)
    edges = edges.groupBy("src", "dst").agg(getattr(F, combine)("weight").alias("weight"))
    if vertices is None:
        vertices = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return Graph(vertices, edges, directed)
