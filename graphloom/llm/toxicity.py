"""Toxicity scores from character n-grams scaled by naive Bayes log-count ratios.

1. Every labelled text that is not held out counts, once a document, its hashed
   character n-grams by class; counts are added up in each task and then in two
   steps, so what is shuffled are tables of fixed size, whatever the corpus. Of
   the corpus only texts whose id passes a Bloom filter of the labels (of at
   most BLOOM_BITS bits) are shuffled to meet their label.
2. r = log(P(feature | 1) / P(feature | 0)), with one added to each count. All
   features take part, each scaled by its r.
3. A logistic regression with an L2 penalty, on presence so scaled, is fitted by
   dual coordinate descent until its duality gap is small, on at most
   ``max_fit_docs`` labelled documents and ``max_fit_bytes`` of features, which
   one task holds. The mark of 0.5 is placed by cross-validation on the same
   documents: where fewest errors are made among the marks that reject at most
   CLEAN_LOST of the clean ones.
4. All texts are scored in one pass without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from graphloom.llm.batches import bounded, map_batches, without
from graphloom.plans import save

ORDERS = (3, 4, 5)
BUCKETS = 1 << 18
#: Parts of the table of counts, each added up on its own.
PARTS = 16
#: Bits of the filter of labelled ids, at most (16 MB); with more labels it lets more texts through, but loses none.
BLOOM_BITS = 1 << 27
#: The descent ends when the gap between its primal and dual value is this part of the primal one; so many rounds without that are an error.
GAP, MOST_ROUNDS = 1e-3, 500
#: Parts of the cross-validation, and the share of clean documents that may lie above the mark.
PARTS_OF_FIT, CLEAN_LOST = 5, 0.005
#: Characters hashed at a time; a longer text goes in overlapping pieces.
PIECE = 1 << 20
_PRIME, _LAST = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


def _hashed(text: str) -> Iterator[np.ndarray]:
    """Buckets of the text's n-grams, with repeats: lower case, white space runs as one space, a space at both ends."""
    points = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
    for begin in range(0, max(1, len(points) - ORDERS[-1] + 1), PIECE):
        piece = points[begin : begin + PIECE + ORDERS[-1] - 1]
        h = np.zeros(len(piece), dtype=np.uint32)
        for n in range(1, ORDERS[-1] + 1):
            if len(piece) < n:
                break
            h = (h[: len(piece) - n + 1] + piece[n - 1 :]) * _PRIME
            if n in ORDERS:
                yield ((h ^ (h >> np.uint32(15))) * _LAST >> np.uint32(32 - 18)).astype(np.int32)


class _Present:
    """Distinct buckets of a text, by marking a table and not by sorting."""

    def __init__(self) -> None:
        self.mark = np.zeros(BUCKETS, dtype=bool)

    def of(self, text: str) -> np.ndarray:
        found = []
        for h in _hashed(text):
            self.mark[h] = True
            found.append(h)
        at = np.concatenate(found) if found else np.zeros(0, np.int32)
        at = np.flatnonzero(self.mark) if len(at) > BUCKETS // 4 else self._first(at)
        self.mark[at] = False
        return at

    def _first(self, at: np.ndarray) -> np.ndarray:
        if not hasattr(self, "last"):
            self.last = np.zeros(BUCKETS, dtype=np.int32)
        number = np.arange(len(at), dtype=np.int32)
        self.last[at] = number
        return at[self.last[at] == number]


@dataclass
class Model:
    """weights: of each bucket, 0 for those that take no part; constant: the score where there is nothing to learn from; mark: the log-odds of the fit that score 0.5; gap: the duality gap of the fit over its loss."""

    weights: np.ndarray
    bias: float
    constant: float | None = None
    mark: float = 0.0
    gap: float = 0.0

    def score(self, features: np.ndarray) -> float:
        if self.constant is not None:
            return self.constant
        z = self.bias - self.mark + float(self.weights[features].sum())
        return 1.0 / (1.0 + np.exp(-z)) if z >= 0 else float(np.exp(z) / (1.0 + np.exp(z)))


def held_out(id_col: str | Column, folds: int = 5) -> Column:
    """True where the CRC-32 of the id as text is a multiple of ``folds``; such rows are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(True))


def _maybe_labelled(docs: DataFrame, y: DataFrame, n: int) -> DataFrame:
    """Rows of ``docs`` (id, text) whose id may be one of the n ids of ``y``: a Bloom filter of one hash, sent as rows of 4 KB."""
    cell = 8 * 4096
    cells = min(BLOOM_BITS, max(1 << 20, 1 << (32 * n).bit_length())) // cell
    h = F.pmod(F.xxhash64("id"), F.lit(cells * cell))
    bits = y.select(h.alias("h")).groupBy(F.floor(F.col("h") / cell).cast("int").alias("cell")).agg(F.bitmap_construct_agg(F.col("h") % cell).alias("bits"))
    at = h % cell
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    set_ = F.expr("shiftright(byte, bit) & 1 = 1")
    placed = docs.withColumn("cell", F.floor(h / cell).cast("int")).join(F.broadcast(bits), "cell")
    return placed.withColumns({"byte": byte, "bit": (at % 8).cast("int")}).where(set_).select("id", "text")


def _counted(labelled: DataFrame) -> DataFrame:
    """One pass over y, text, chosen, id: rows of counts (part, task, n) and rows of features (id, y, features) of the chosen ids."""
    width = BUCKETS // PARTS
    names = ["part", "task", "n", "id", "y", "features"]
    schema = f"part int, task int, n binary, id {labelled.schema['id'].dataType.simpleString()}, y int, features binary"
    id_type = to_arrow_type(labelled.schema["id"].dataType)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n, chosen = _Present(), np.zeros((2, BUCKETS), dtype=np.uint32), {}
        for batch in batches:
            for y, text, fit, name in zip(*(batch[c].to_pylist() for c in ("y", "text", "chosen", "id")), strict=True):
                at = seen.of(text or "")
                n[y, at] += 1
                if fit:  # of rows that repeat an id one takes part, the same whatever their order
                    data = np.sort(at).astype("<i4").tobytes()
                    chosen[name] = (y, min(data, chosen[name][1]) if name in chosen else data)
        task = TaskContext.get().partitionId() % 64
        for part in range(PARTS if n.any() else 0):
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([task], pa.int32()), pa.array([n[:, part * width : (part + 1) * width].tobytes()], pa.binary()), pa.nulls(1, id_type), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary())], names)
        for name, (y, data) in chosen.items():
            yield pa.record_batch([pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.array([name], id_type), pa.array([y], pa.int32()), pa.array([data], pa.binary())], names)

    bounded(labelled.sparkSession)
    return save(labelled.mapInArrow(count, schema), "toxicity-counts")


def _class_counts(counted: DataFrame) -> np.ndarray:
    """(2, BUCKETS) documents of each class that hold a feature."""
    width = BUCKETS // PARTS

    def add(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * width, dtype=np.int64)
        for batch in rows:
            for x in batch["n"].to_pylist():
                total += np.frombuffer(x, dtype=np.uint32 if len(x) == 8 * width else np.int64)
        yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "n"])

    out = np.zeros((2, BUCKETS), dtype=np.int64)
    some = counted.where("part is not null").select("part", "task", "n").groupBy("part", "task").applyInArrow(add, "part int, n binary")
    for row in some.groupBy("part").applyInArrow(add, "part int, n binary").collect():  # of fixed size
        out[:, row["part"] * width : (row["part"] + 1) * width] = np.frombuffer(row["n"], dtype=np.int64).reshape(2, width)
    return out


def _gap(features: list[np.ndarray], sign: np.ndarray, a: np.ndarray, w: np.ndarray, bias: float, scale: np.ndarray, penalty: float) -> float:
    """The duality gap over the primal value."""
    z = np.array([w[f].sum() for f in features]) + bias
    some = scale != 0
    square = penalty / 2 * (float(np.square(w[some] / scale[some]).sum()) + (bias / 10.0) ** 2)
    loss = float(np.logaddexp(0.0, -sign * z).sum())
    entropy = -float((a * np.log(np.maximum(a, 1e-300)) + (1 - a) * np.log(np.maximum(1 - a, 1e-300))).sum())
    return (loss + square - (entropy - square)) / (loss + square)


def descend(features: list[np.ndarray], y: np.ndarray, scale: np.ndarray, penalty: float) -> tuple[np.ndarray, float, float]:
    """(weights of presence, bias, gap) that minimise the log loss + penalty / 2 * |w|^2 for features scaled by ``scale``.

    Dual coordinate descent: a document's dual variable a in (0, 1) solves
    sign * z + q * (a - old) + log(a / (1 - a)) = 0, found by bisection between
    bounds that bracket it. The bias is a feature of value 10. RuntimeError if
    the gap stays above GAP.
    """
    sign, square = 2.0 * y - 1.0, scale * scale
    a = np.full(len(y), 1e-3)
    w, bias = np.zeros(len(scale)), 0.0  # w: of presence, the scaling applied
    size = np.array([square[f].sum() for f in features]) / penalty + 100.0 / penalty
    for f, s, x in zip(features, sign.tolist(), a.tolist(), strict=True):
        w[f] += s * x / penalty * square[f]
        bias += s * x / penalty * 100.0
    order = np.random.default_rng(0)
    for n in range(MOST_ROUNDS):
        for i in order.permutation(len(features)).tolist():
            f, s, q, old = features[i], float(sign[i]), float(size[i]), float(a[i])
            margin = s * (float(w[f].sum()) + bias)
            low, high = 0.0, 1.0
            for _ in range(40):
                middle = (low + high) / 2
                if margin + q * (middle - old) + math.log(max(middle, 1e-300) / max(1.0 - middle, 1e-300)) > 0:
                    high = middle
                else:
                    low = middle
            step = (low + high) / 2 - old
            if abs(step) > 1e-9:
                a[i] = old + step
                w[f] += s * step / penalty * square[f]
                bias += s * step / penalty * 100.0
        if n % 4 == 3 and (gap := _gap(features, sign, a, w, bias, scale, penalty)) < GAP:
            return w, bias, gap
    raise RuntimeError(f"the fit has not settled: its duality gap is {gap:.2g} of its loss")


def _ratios(counts: np.ndarray, n: tuple[int, int]) -> np.ndarray:
    p = (counts + 1.0) / (np.array([[n[0]], [n[1]]]) + 2.0)
    return np.log(p[1] / p[0])


def mark(z: np.ndarray, y: np.ndarray) -> float:
    """The log-odds from which on a document is rejected: fewest errors while at most CLEAN_LOST of the clean ones are above, the widest gap on ties."""
    order = np.argsort(-z, kind="stable")
    z, y = z[order], y[order]
    above_toxic, above_clean = np.append(0, np.cumsum(y)), np.append(0, np.cumsum(1 - y))
    edges = np.concatenate([[z[0] + 2.0], z, [z[-1] - 2.0]])
    width = edges[:-1] - edges[1:]
    errors = y.sum() - above_toxic + above_clean
    free = (above_clean <= CLEAN_LOST * (1 - y).sum()) & (width > 0)
    best = np.flatnonzero(free & (errors == errors[free].min()))
    k = best[np.argmax(width[best])]
    return float((edges[k] + edges[k + 1]) / 2)


def regress(features: list[np.ndarray], y: np.ndarray, counts: np.ndarray, n: tuple[int, int], penalty: float) -> tuple[np.ndarray, float, float, float]:
    """(weights, bias, mark, gap) of the model, whose mark of 0.5 comes from parts of the documents scored by models of the others.

    ``counts`` and ``n``: documents by class, with and without a feature, of
    which those of ``features`` are some; a part's counts are taken away for its
    models. Parts without both classes on either side leave the mark at 0.
    """
    w, bias, gap = descend(features, y, _ratios(counts, n), penalty)
    part, z = np.arange(len(y)) % PARTS_OF_FIT, np.zeros(len(y))
    for k in range(PARTS_OF_FIT):
        own, others = np.flatnonzero(part == k), np.flatnonzero(part != k)
        if len(set(y[others].tolist())) < 2 or not len(own):
            return w, bias, 0.0, gap
        less = counts.copy()
        for i in own:
            less[int(y[i]), features[i]] -= 1
        left = (n[0] - int((y[own] == 0).sum()), n[1] - int((y[own] == 1).sum()))
        v, b, _ = descend([features[i] for i in others], y[others], _ratios(less, left), penalty)
        z[own] = [b + float(v[features[i]].sum()) for i in own]
    return w, bias, mark(z, y), gap


def fit(docs: DataFrame, labels: DataFrame, max_fit_docs: int = 5_000, max_fit_bytes: int = 512 << 20, penalty: float = 10.0, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from the labelled rows that are not held out.

    Counts of features cover all of these rows; the regression takes the
    ``max_fit_docs`` ids of the lowest hash, of rows that repeat an id one, and
    of those as many as have ``max_fit_bytes`` of features (4 bytes each). Null
    labels or ids are left out; of several labels of one id the largest counts;
    columns of other names are not read. Without labels the score is 0.5, with
    one class only it is that class.
    """
    y = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col, folds))
    y = save(y.groupBy(F.col(id_col).alias("id")).agg(F.max(F.when(F.col(label_col) > 0, 1).otherwise(0)).alias("y")), "labels")
    n = {r["y"]: r["count"] for r in y.groupBy("y").count().collect()}
    if len(n) < 2:
        return Model(np.zeros(BUCKETS), 0.0, 0.5 if not n else float(next(iter(n))))
    few = y.orderBy(F.xxhash64("id"), "id").limit(max_fit_docs).select("id", F.lit(True).alias("chosen"))  # the bound of this broadcast
    marked = y.join(F.broadcast(few), "id", "left")
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counted = _counted(_maybe_labelled(text, y, sum(n.values())).join(marked.hint("merge"), "id").select("id", "y", "chosen", "text"))
    counts = _class_counts(counted)
    classes = (n[0], n[1])

    def learn(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        for batch in rows:
            for name, label, data in zip(*(batch[c].to_pylist() for c in ("id", "y", "features")), strict=True):
                best[name] = (label, min(data, best[name][1]) if name in best else data)
        target = np.array([best[i][0] for i in sorted(best)], dtype=np.float64)
        w, bias, at, gap = regress([np.frombuffer(best[i][1], "<i4") for i in sorted(best)], target, counts, classes, penalty)
        yield pa.record_batch([pa.array([w.tobytes()], pa.binary()), pa.array([bias]), pa.array([at]), pa.array([gap])], ["w", "bias", "mark", "gap"])

    chosen = counted.where("features is not null").select("id", "y", "features")
    sizes = chosen.groupBy("id").agg(F.sum(F.octet_length("features")).alias("bytes"))  # at most max_fit_docs rows from here on
    fit_in = sizes.withColumn("sum", F.sum("bytes").over(Window.orderBy(F.xxhash64("id"), "id"))).where(F.col("sum") <= max_fit_bytes).select("id")
    row = chosen.join(F.broadcast(fit_in), "id").select("id", "y", "features").coalesce(1).mapInArrow(learn, "w binary, bias double, mark double, gap double").first()
    return Model(np.frombuffer(row["w"]), row["bias"], None, row["mark"], row["gap"]) if row else Model(np.zeros(BUCKETS), 0.0, n[1] / (n[0] + n[1]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) to every row, from the whole text alone.

    Null text counts as empty and is scored too. Columns with these names are
    replaced; all others pass through; an empty table gives an empty table.
    """
    kept = without(docs, "score", "predicted")
    at, weights = kept.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def make():
        model, seen = weights.value, _Present()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            s = np.array([model.score(seen.of(x or "")) for x in batch.column(at).to_pylist()], dtype=np.float64)
            return pa.record_batch([*batch.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

        return each

    fields = [T.StructField(f.name, f.dataType) for f in kept.schema]
    return map_batches(kept, make, T.StructType([*fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
