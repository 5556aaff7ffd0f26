"""A graph that follows a stream of changes.

Changes are rows (seq, kind, src, dst, weight): kind is ``add_edge``,
``remove_edge``, ``add_node`` or ``remove_node`` (nodes in src). Within and
across batches the last change of an edge by seq wins; removing a node removes
its edges. Each batch is folded into the tables of the last one; a batch that
is replayed after a failure starts from the same version again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.graph import Graph


def fold(graph: Graph, changes: DataFrame) -> Graph:
    """The graph after ``changes``, as one plan."""
    ends = (F.col("src"), F.col("dst")) if graph.directed else (F.least("src", "dst"), F.greatest("src", "dst"))
    edge = changes.where("kind in ('add_edge', 'remove_edge')").select(ends[0].alias("src"), ends[1].alias("dst"), "weight", "kind", "seq")
    last = edge.groupBy("src", "dst").agg(F.max(F.struct("seq", "kind", "weight")).alias("x"))
    node = changes.where("kind in ('add_node', 'remove_node')").groupBy(F.col("src").alias("id")).agg(F.max(F.struct("seq", "kind")).alias("n"), F.max(F.when(F.col("kind") == "remove_node", F.col("seq"))).alias("gone_at"))
    kept = graph.edges.join(last, ["src", "dst"], "left_anti").select("src", "dst", "weight", F.lit(-1).cast("long").alias("at"))
    new = last.where("x.kind = 'add_edge'").select("src", "dst", F.col("x.weight").alias("weight"), F.col("x.seq").cast("long").alias("at"))
    edges = kept.unionByName(new)
    for c in ("src", "dst"):
        gone = node.where("gone_at is not null").select(F.col("id").alias(c), "gone_at")
        edges = edges.join(gone, c, "left").where("gone_at is null or at > gone_at").drop("gone_at")
    edges = edges.select("src", "dst", "weight")
    removed = node.where("n.kind = 'remove_node'").select("id")
    ids = graph.vertices.select("id").join(removed, "id", "left_anti").unionByName(node.where("n.kind = 'add_node'").select("id"))
    ids = ids.unionByName(edges.select(F.col("src").alias("id"))).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return Graph(ids, edges, graph.directed)


class LiveGraph:
    """Tables of a graph in a folder, one version for each batch folded in."""

    def __init__(self, spark: SparkSession, path: str, directed: bool) -> None:
        self.spark, self.path, self.directed = spark, path.rstrip("/"), directed

    def _version(self) -> int:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        store = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(folder):
            return -1
        names = [s.getPath().getName() for s in store.listStatus(folder)]
        done = [int(x[1:]) for x in names if x.startswith("e") and store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{x}/_SUCCESS"))]
        return max(done, default=-1)

    def graph(self, version: int | None = None) -> Graph:
        version = self._version() if version is None else version
        if version < 0:
            return Graph(self.spark.createDataFrame([], "id long"), self.spark.createDataFrame([], "src long, dst long, weight double"), self.directed)
        return Graph(self.spark.read.parquet(f"{self.path}/v{version}"), self.spark.read.parquet(f"{self.path}/e{version}"), self.directed)

    def apply(self, changes: DataFrame, batch: int) -> None:
        """Fold a batch in; writes version ``batch`` from version ``batch`` - 1."""
        new = fold(self.graph(batch - 1), changes)
        new.vertices.write.mode("overwrite").parquet(f"{self.path}/v{batch}")
        new.edges.write.mode("overwrite").parquet(f"{self.path}/e{batch}")

    def follow(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(lambda df, i: self.apply(df, i)).option("checkpointLocation", checkpoint).start()
