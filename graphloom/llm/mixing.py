"""Mixing sources to target weights along a time-varying curriculum.

1. Targets: the sources' mean weights share the wanted number of words; a
   target stops at ``most_repeats`` times its source, and what is left over is
   shared again by weight among the others.
2. Repeats: every document of a source is taken floor(target / size) times;
   the rest goes to single documents, chosen from the histogram of sizes so
   that the error after the smallest size is at most half of that size. Which
   documents of one size take part is decided by rank of a hash.
3. Positions: a source's demand at time t is the integral of its weight
   schedule. The running total of words of its copies, in hashed order, is
   carried through the inverse of that integral; documents are then sorted by
   range of the position in training so found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.batches import bounded, n_words, of_doc, row_hashes, whole_rows
from graphloom.plans import running_total, save, shuffle_partitions

#: A schedule is a list of (time from 0 to 1, weight), straight between its knots.
Schedule = Sequence[tuple[float, float]]


def repeating(weights: Sequence[Schedule | float]) -> Callable[[int, str | None], Schedule]:
    """Schedules for sources in their order, repeating; a number is a constant weight."""
    return lambda i, _: [(0.0, w), (1.0, w)] if isinstance(w := weights[i % len(weights)], (int, float)) else w


def mean_weight(schedule: Schedule) -> float:
    t, w = np.array(schedule, dtype=np.float64).T
    return float(np.sum(np.diff(t) * (w[1:] + w[:-1]) / 2))


def time_of_demand(schedule: Schedule, share: np.ndarray) -> np.ndarray:
    """Inverse of the integral of a schedule: when a share (0 to 1) of a source's demand has been met."""
    t, w = np.array(schedule, dtype=np.float64).T
    total = np.concatenate([[0.0], np.cumsum(np.diff(t) * (w[1:] + w[:-1]) / 2)])
    want = np.clip(share, 0.0, 1.0) * total[-1]
    i = np.clip(np.searchsorted(total, want, side="right") - 1, 0, len(t) - 2)
    rest, slope, width = want - total[i], (w[i + 1] - w[i]) / np.maximum(t[i + 1] - t[i], 1e-300), t[i + 1] - t[i]
    root = np.sqrt(np.maximum(w[i] ** 2 + 2 * slope * rest, 0.0))
    step = np.where(w[i] + root > 0, 2 * rest / np.maximum(w[i] + root, 1e-300), 0.0)
    return np.minimum(t[i] + np.minimum(step, width), 1.0)


def weighed(sizes: DataFrame, schedule: Callable[[int, str | None], Schedule], fraction: float = 1.0, most_repeats: int = 3) -> DataFrame:
    """(source, i, total, weight, target) of (source, total); i numbers the sources by code point, null last.

    Targets share ``fraction`` of all sizes by mean weight; those above
    ``most_repeats`` times their source stop there, and the excess is shared
    again until none is above. Sources stay rows all along: a round is one sum.
    """
    bounded(sizes.sparkSession)

    def weigh(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            yield pdf.assign(weight=[mean_weight(schedule(int(i), None if pd.isna(s) else s)) for i, s in zip(pdf["i"], pdf["source"], strict=True)])

    one = sizes.withColumn("g", F.lit(0))
    placed = running_total(one, ["g"], [F.col("source").isNull(), F.encode("source", "UTF-8"), F.col("total")], F.lit(1).cast("long"), "i").drop("g")
    state = save(placed.mapInPandas(weigh, "source string, total long, i long, weight double").withColumn("target", F.lit(None).cast("double")), "sources")
    while True:
        most = most_repeats * F.col("total").cast("double")
        r = state.agg(F.sum("total").alias("all"), F.coalesce(F.sum("target"), F.lit(0.0)).alias("met"), F.coalesce(F.sum(F.when(F.col("target").isNull(), F.col("weight"))), F.lit(0.0)).alias("open")).first()
        give = F.col("weight") * F.lit((fraction * (r["all"] or 0) - r["met"]) / r["open"] if r["open"] else 0.0)
        over = F.col("target").isNull() & (give > most)
        if state.where(over).isEmpty():
            return save(state.withColumn("target", F.coalesce("target", give)), "targets")
        state = save(state.withColumn("target", F.when(over, most).otherwise(F.col("target"))), "sources")


def extra_by_size(sizes: np.ndarray, n: np.ndarray, share: float) -> np.ndarray:
    """How many of the n documents of each size to take once more, so that the sums follow ``share``; sizes in any order."""
    out, want, taken = np.zeros(len(sizes), dtype=np.int64), 0.0, 0
    for i in np.argsort(-sizes, kind="stable"):
        size, count = int(sizes[i]), int(n[i])
        want += share * size * count
        if size > 0:
            out[i] = min(count, max(0, int(np.floor((want - taken) / size + 0.5))))
            taken += int(out[i]) * size
    return out


def plan(docs: DataFrame, schedule: Callable[[int, str | None], Schedule], fraction: float = 1.0, most_repeats: int = 3, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A narrow row for each row of ``docs``: id, row and row2 (hashes of all columns), source, i (its number), size, rank, source_size, target, repeats.

    Size is the number of words; null text has none and is never taken. Null
    is a source of its own. (source, size, rank) names a row, so repeated rows
    keep a row each; a hash of row and seed orders rows of one size, so reruns
    agree. An empty table gives an empty one.
    """
    bounded(docs.sparkSession)
    narrow = save(docs.select(F.col(id_col).alias("id"), *row_hashes(docs), F.col(source_col).alias("source"), n_words(text_col).alias("size")), "sizes")
    hist = save(narrow.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "histogram")
    of = weighed(hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("total")), schedule, fraction, most_repeats)

    def extra(pdf: pd.DataFrame) -> pd.DataFrame:
        size, target = int(pdf["total"].iloc[0]), float(pdf["target"].iloc[0])
        base = min(int(target // size), most_repeats) if size else 0
        share = target / size - base if size and base < most_repeats else 0.0
        return pdf.assign(base=base, more=extra_by_size(pdf["size"].to_numpy(), pdf["n"].to_numpy(), share))[["k", "size", "total", "target", "base", "more"]]

    each = hist.join(of.withColumnRenamed("source", "s"), hist["source"].eqNullSafe(F.col("s"))).select(F.col("i").alias("k"), "size", "n", "total", "target")
    chosen = save(each.groupBy("k").applyInPandas(extra, "k long, size long, total long, target double, base long, more long").withColumnRenamed("size", "z"), "repeats")
    numbered = narrow.join(of.select(F.col("source").alias("s"), "i"), narrow["source"].eqNullSafe(F.col("s"))).drop("s")
    ranked = running_total(numbered, ["i", "size"], [F.xxhash64(F.lit(seed), "row", "row2"), F.col("row"), F.col("row2")], F.lit(1).cast("long"), "rank")
    repeats = F.col("base") + F.when(F.col("rank") < F.col("more"), 1).otherwise(0)
    both = ranked.join(chosen, (ranked["i"] == chosen["k"]) & (ranked["size"] == chosen["z"]))
    return save(both.select("id", "row", "row2", "source", "i", "size", "rank", F.col("total").alias("source_size"), "target", repeats.alias("repeats")), "plan")


def positions(planned: DataFrame, schedule: Callable[[int, str | None], Schedule], seed: int = 0) -> DataFrame:
    """A row for each copy of a document that has words: id, row, row2, i, size, rank, copy, position (0 to 1)."""
    copies = planned.where("repeats > 0 and size > 0").select("id", "row", "row2", "source", "i", "size", "rank", F.explode(F.sequence(F.lit(1).cast("long"), "repeats")).alias("copy"))
    taken = planned.where("repeats > 0").groupBy("i").agg(F.sum(F.col("size") * F.col("repeats")).alias("taken"))
    order = [F.xxhash64(F.lit(seed + 1), "row", "row2", "rank", "copy"), F.col("row"), F.col("row2"), F.col("rank"), F.col("copy")]
    summed = running_total(copies, ["i"], order, F.col("size"), "before").join(taken, "i")

    @F.pandas_udf(T.DoubleType())
    def when(i: pd.Series, source: pd.Series, share: pd.Series) -> pd.Series:
        out = np.zeros(len(i))
        for k in i.unique():
            mine = np.flatnonzero((i == k).to_numpy())
            name = source.iloc[mine[0]]
            out[mine] = time_of_demand(schedule(int(k), None if pd.isna(name) else name), share.to_numpy()[mine])
        return pd.Series(out)

    return summed.select("id", "row", "row2", "i", "size", "rank", "copy", when("i", "source", (F.col("before") + F.col("size") / 2) / F.col("taken")).alias("position"))


def mix(docs: DataFrame, schedule: Callable[[int, str | None], Schedule], fraction: float = 1.0, most_repeats: int = 3, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, sorted by their new column ``position``.

    Documents without words take part in no mix. An empty table gives an empty
    table. An input column named position is replaced.
    """
    at = positions(plan(docs, schedule, fraction, most_repeats, seed, id_col, text_col, source_col), schedule, seed).select("row", "row2", "position")
    columns = [c for c in docs.columns if c.lower() != "position"]
    both = at.join(whole_rows(docs), ["row", "row2"])
    dealt = both.select(*of_doc(docs, columns), "position")
    return dealt.repartitionByRange(shuffle_partitions(docs.sparkSession), "position").sortWithinPartitions("position")
