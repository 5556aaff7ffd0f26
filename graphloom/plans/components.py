"""Connected components by alternating star contractions.

Large-star links every larger neighbour of a vertex to the smallest one around
it, small-star does the same for the smaller neighbours; both keep the
components and end in stars around each component's smallest vertex after
O(log^2 n) rounds, a few in practice. Each half round is an aggregate (which
combines before the shuffle, so hubs are cheap) and an equi-join that adaptive
execution can split where a hub is hot. One aggregate over the ends tells whether
only stars are left, so no round is spent to see that nothing moves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.shared import drop_saved, save


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _stars(edges: DataFrame) -> bool:
    """Every larger end has one link, and no smaller end is a larger one elsewhere: nothing is left to contract."""
    upper = edges.select(F.col("u").alias("id"), F.lit(1).alias("links"), F.lit(0).alias("below"))
    lower = edges.select(F.col("v").alias("id"), F.lit(0).alias("links"), F.lit(1).alias("below"))
    ends = upper.unionByName(lower).groupBy("id").agg(F.sum("links").alias("links"), F.max("below").alias("below"))
    return not ends.agg(F.max(F.col("links") + F.col("below") > 1)).first()[0]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(id, component) for every endpoint of ``edges``; component is its smallest member.

    Null endpoints are ignored; a vertex that only has loops is its own component.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    pairs = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    kept = save(pairs, "edges")
    state = start = kept.where("u <> v")
    for _ in range(max_rounds):
        if _stars(state):
            break
        new = save(_small_star(_large_star(state)), "stars")
        if state is not start:
            drop_saved(state)
        state = new
    else:
        raise RuntimeError("components did not settle")
    roots = state.select(F.col("v").alias("id")).unionByName(kept.where("u = v").select(F.col("u").alias("id"))).distinct()
    stars = state.select(F.col("u").alias("id"), F.col("v").alias("component"))
    alone = roots.join(stars, "id", "left_anti").select("id", F.col("id").alias("component"))
    return stars.unionByName(alone)
