"""Rounds of a plan until nothing changes, each round cut off in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from graphloom.plans.shared import drop_saved, fresh_path, save


def fixpoint(state: DataFrame, step: Callable[[DataFrame], DataFrame], changed: Column | str, max_rounds: int = 10_000, partial: bool = False) -> DataFrame:
    """Apply ``step`` until no row satisfies ``changed`` any more; returns the last table.

    Rounds that run out with rows still changing are an error, unless a
    ``partial`` result is asked for.
    """
    state = save(state, "round")
    for _ in range(max_rounds):
        new = save(step(state), "round")
        done = new.where(changed).isEmpty()
        drop_saved(state)
        state = new
        if done:
            return state
    if not partial and not state.where(changed).isEmpty():
        raise RuntimeError(f"rows still change after {max_rounds} rounds")
    return state


def spread(start: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str], max_rounds: int = 100_000, partial: bool = False) -> DataFrame:
    """All rows reached from ``start``: each round ``step`` makes rows from those new in the last one, and rows of known ``keys`` are dropped.

    A round appends its new rows to the table; what is known is read, never
    written again. Rounds that run out while rows are still found are an error,
    unless a ``partial`` result is asked for.
    """
    spark, path, schema = start.sparkSession, fresh_path(start.sparkSession, "spread"), start.schema
    start.write.parquet(f"{path}/0")
    for n in range(max_rounds):
        known = spark.read.schema(schema).parquet(*(f"{path}/{i}" for i in range(n + 1)))
        front = spark.read.schema(schema).parquet(f"{path}/{n}")
        step(front).select(*schema.names).join(known.select(*keys), keys, "left_anti").select(*schema.names).write.parquet(f"{path}/{n + 1}")
        if spark.read.schema(schema).parquet(f"{path}/{n + 1}").isEmpty():
            return known
    if not partial:
        raise RuntimeError(f"rows are still found after {max_rounds} rounds")
    return spark.read.schema(schema).parquet(*(f"{path}/{i}" for i in range(max_rounds + 1)))


def rounds(state: DataFrame, step: Callable[[DataFrame], DataFrame], n: int, done: Callable[[DataFrame, DataFrame], bool] | None = None) -> DataFrame:
    """``n`` rounds; or, with ``done(old, new)``, until that holds, and an error if it does not after ``n``."""
    state = save(state, "round")
    for _ in range(n):
        new = save(step(state), "round")
        stop = done is not None and done(state, new)
        drop_saved(state)
        state = new
        if stop:
            return state
    if done is not None:
        raise RuntimeError(f"not settled after {n} rounds")
    return state
