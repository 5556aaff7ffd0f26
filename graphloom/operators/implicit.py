"""Graphs that are never built: states of any columns, and a plan that makes the successors of a table of states."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.fixpoint import fixpoint, spread

Successors = Callable[[DataFrame], DataFrame]


def explore(starts: DataFrame, successors: Successors, visited_by: dict[str, Column] | None = None, max_depth: int | None = None, goal: Column | None = None) -> DataFrame:
    """All states reached from ``starts``, with ``depth``, in breadth-first order.

    ``successors`` gets a table of states and returns one of the same columns,
    made by any plan: expressions, joins, or a function over Arrow batches.
    States are the same if the columns of ``visited_by`` (name to expression;
    by default all columns as they are) are, nulls being equal to each other;
    of states that are the same and found in one round the least is kept. At
    ``max_depth`` nothing is expanded; states that meet ``goal`` are returned
    and not expanded. ``depth``, ``_key`` and ``_state`` are reserved names.
    """
    names = starts.columns
    keys = F.to_json(F.struct(*(c.alias(k) for k, c in (visited_by or {n: F.col(n) for n in names}).items())), {"ignoreNullFields": "false"})

    def once(states: DataFrame) -> DataFrame:
        least = states.withColumn("_key", keys).groupBy("_key").agg(F.min(F.struct("depth", *names)).alias("_state"))
        return least.select("_key", "_state.*")

    def step(front: DataFrame) -> DataFrame:
        open_ = front if goal is None else front.where(~F.coalesce(goal, F.lit(False)))
        depth = open_.select("depth").limit(1)  # one row: all states of a front were found in the same round
        return once(successors(open_.select(*names)).select(*names).crossJoin(F.broadcast(depth.select((F.col("depth") + 1).alias("depth")))))

    first = once(starts.withColumn("depth", F.lit(0)))
    return spread(first, step, ["_key"], 100_000 if max_depth is None else max_depth, max_depth is not None).select(*names, "depth")


def least_costs(starts: DataFrame, successors: Successors, max_rounds: int = 10_000) -> DataFrame:
    """The states reached from ``starts`` with their least ``cost``.

    ``successors`` gets states with the cost of each so far, expands them and
    returns the same columns, ``cost`` now with the step's cost added. Only
    states whose cost fell in a round are expanded in the next. Steps that never
    stop getting cheaper are an error after ``max_rounds``. States may hold
    nulls but no maps; ``_new`` and ``_old`` are reserved names.
    """
    names = [c for c in starts.columns if c != "cost"]
    cheapest = lambda df: df.groupBy(*names).agg(F.min(F.col("cost").cast("double")).alias("cost"))

    def step(state: DataFrame) -> DataFrame:
        found = successors(state.where("_new").select(*names, "cost")).select(*names, F.col("cost").cast("double").alias("cost"))
        both = state.select(*names, "cost", F.col("cost").alias("_old")).unionByName(found.withColumn("_old", F.lit(None).cast("double")))
        least = both.groupBy(*names).agg(F.min("cost").alias("cost"), F.min("_old").alias("_old"))
        return least.select(*names, "cost", (F.col("_old").isNull() | (F.col("cost") < F.col("_old"))).alias("_new"))

    return fixpoint(cheapest(starts).withColumn("_new", F.lit(True)), step, "_new", max_rounds).select(*names, "cost")
