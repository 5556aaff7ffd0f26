"""Tree decompositions: independent vertices of low degree are eliminated together, round by round."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.plans import drop_saved, fresh_path, save

#: Vertices left over that one task eliminates one by one (a matrix of a million bytes).
BASE = 1024


def _eliminated(width: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Rows (bag, id, owner, step) of the rest of a graph, least degree first; ``owner`` marks the vertices that a bag eliminates."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names, n = np.unique(rows["a"].to_numpy()), rows["a"].nunique()
        ends = rows.dropna()
        near = np.zeros((n, n), dtype=bool)
        near[np.searchsorted(names, ends["a"]), np.searchsorted(names, ends["b"].astype("int64"))] = True
        degree, live, most, out = near.sum(axis=1), np.ones(n, dtype=bool), width, []
        for step in range(n):
            v = int(np.argmin(np.where(live, degree, n + 1)))
            most = max(most, int(degree[v]))
            if live.sum() <= most + 1:  # what is left fits into one bag
                rest = names[live]
                out.append(pd.DataFrame({"bag": rest[0], "id": rest, "owner": True, "step": step}))
                break
            around = np.flatnonzero(near[v])
            out.append(pd.DataFrame({"bag": names[v], "id": names[np.append(around, v)], "owner": [False] * len(around) + [True], "step": step}))
            near[np.ix_(around, around)] = True
            near[around, around] = False
            near[around, v] = near[v, around] = live[v] = False
            degree[around] = near[around].sum(axis=1)
        return pd.concat(out)

    return run


def tree_decomposition(graph: Graph, seed: int = 0, base: int = BASE) -> tuple[DataFrame, DataFrame]:
    """(bag, id) and (bag, parent): a tree of bags in which every edge lies in a bag and the bags of a vertex hang together.

    Directions, weights and loops do not count. A bag is named after the vertex
    that it eliminates, the last one after its smallest; its other members are
    the neighbours of that vertex at the time, which become a clique. A round
    eliminates all vertices of at most the width so far, or else of the least
    degree, that come before their neighbours of this kind by (degree, hash):
    they are not adjacent, so one after the other would give the same. Thus
    trees and other sparse graphs take about a logarithm of rounds. Up to
    ``base`` vertices that are left end in one task; a dense part beyond that
    takes about a round a vertex. A piece's last bag has no parent; an empty
    graph has no bags.
    """
    spark, path, schema = graph.spark, fresh_path(graph.spark, "bags"), "bag long, id long, owner boolean, step int, round int"
    left = save(graph.vertices.select("id").distinct(), "left")
    edges = save(graph.both_ways().where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct(), "edges")
    width = turn = 0
    while n := left.count():
        if n <= base:
            rest = left.select(F.col("id").alias("a")).join(edges, "a", "left")
            rest.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(_eliminated(width), "bag long, id long, owner boolean, step int").withColumn("round", F.lit(turn)).write.parquet(f"{path}/{turn}")
            turn += 1
            break
        if n <= width + 1:
            last = left.select(F.lit(left.agg(F.min("id")).first()[0]).alias("bag"), "id", F.lit(True).alias("owner"), F.lit(0).alias("step"), F.lit(turn).alias("round"))
            last.write.parquet(f"{path}/{turn}")
            turn += 1
            break
        degree = edges.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("d"))
        ranked = save(left.join(degree, "id", "left").select("id", F.struct(F.coalesce("d", F.lit(0)).alias("d"), F.xxhash64(F.lit(seed), "id").alias("h"), "id").alias("p")), "ranked")
        width = max(width, ranked.agg(F.min("p.d")).first()[0])
        low = ranked.where(F.col("p.d") <= width)
        around = edges.join(low.select(F.col("id").alias("b"), "p"), "b").groupBy(F.col("a").alias("id")).agg(F.min("p").alias("q"))
        now = save(low.join(around, "id", "left").where("q is null or p < q").select("id"), "chosen")
        own = save(edges.join(now.withColumnRenamed("id", "a"), "a", "left_semi"), "own")
        bags = own.select(F.col("a").alias("bag"), F.col("b").alias("id"), F.lit(False).alias("owner")).unionByName(now.select(F.col("id").alias("bag"), "id", F.lit(True).alias("owner")))
        bags.select("*", F.lit(0).alias("step"), F.lit(turn).alias("round")).write.parquet(f"{path}/{turn}")
        fill = own.join(own.select("a", F.col("b").alias("c")), "a").where("b <> c").select(F.col("b").alias("a"), F.col("c").alias("b"))
        kept = edges.join(now.withColumnRenamed("id", "a"), "a", "left_anti").join(now.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b")
        before = left, edges, ranked, now, own
        left, edges = save(left.join(now, "id", "left_anti"), "left"), save(kept.unionByName(fill).distinct(), "edges")
        drop_saved(*before)
        turn += 1
    if not turn:
        return spark.createDataFrame([], "bag long, id long"), spark.createDataFrame([], "bag long, parent long")
    made = spark.read.schema(schema).parquet(*(f"{path}/{i}" for i in range(turn)))
    owner = made.where("owner").select("id", F.struct("round", "step", F.col("bag").alias("parent")).alias("o"))
    up = made.select("bag", "id").join(owner, "id").where("o.parent <> bag").groupBy("bag").agg(F.min("o").alias("o"))
    tree = made.select("bag").distinct().join(up, "bag", "left").select("bag", "o.parent")
    return made.select("bag", "id"), tree


def treewidth_upper_bound(graph: Graph, seed: int = 0, base: int = BASE) -> DataFrame:
    """One row (width): the largest bag of ``tree_decomposition`` less one, 0 for an empty graph."""
    bags, _ = tree_decomposition(graph, seed, base)
    return bags.groupBy("bag").agg(F.count(F.lit(1)).alias("n")).agg((F.coalesce(F.max("n"), F.lit(1)) - 1).alias("width"))
