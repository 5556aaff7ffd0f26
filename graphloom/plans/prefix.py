"""Running totals over groups of any size, without one task for a group.

Rows are dealt by range of (group, order), each partition sums its own rows,
and the sums of the partitions before it are added. Only one row for each
(partition, group) meets in a window, never the rows of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.plans.shared import save, shuffle_partitions


def running_total(df: DataFrame, group: list[str], order: list[Column], value: Column, out: str, partitions: int | None = None, total: str | None = None) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same group that come before in ``order``; and ``total``, if named: the sum over the group.

    ``order`` must be total within a group up to rows that are interchangeable.
    Null group values form one group. The input is written once to the shared
    folder, so pass narrow rows. ``_pid``, ``_o*`` and ``_v`` are reserved names.
    """
    n = partitions or shuffle_partitions(df.sparkSession)
    keys = [f"_o{i}" for i in range(len(order))]
    dealt = df.withColumns({k: c for k, c in zip(keys, order)} | {"_v": value})
    dealt = save(dealt.repartitionByRange(n, *group, *keys).withColumn("_pid", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("_pid", *group).agg(F.sum("_v").alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({"_base": F.coalesce(F.sum("_sum").over(before), F.lit(0)), "_all": F.sum("_sum").over(Window.partitionBy(*group))})
    sums = sums.select(F.col("_pid").alias("_p"), *(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), "_base", "_all")
    match = [dealt["_pid"] == sums["_p"], *(dealt[g].eqNullSafe(sums[f"_g{i}"]) for i, g in enumerate(group))]
    inside = Window.partitionBy("_pid", *group).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.join(sums, match).withColumn(out, F.col("_base") + F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    return summed.select(*df.columns, out, *([F.col("_all").alias(total)] if total else []))
