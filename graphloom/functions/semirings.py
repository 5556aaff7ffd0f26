"""Path algebras as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Semiring:
    """one: value of the empty path; extend: a path by an arc; best: the aggregate that picks among paths."""

    one: float
    extend: Callable[[Column, Column], Column]
    best: Callable[[str], Column]


#: Shortest, widest (largest least weight), longest (of acyclic graphs), least largest weight, and most reliable path.
MIN_PLUS = Semiring(0.0, lambda d, w: d + w, F.min)
MAX_MIN = Semiring(float("inf"), F.least, F.max)
MAX_PLUS = Semiring(0.0, lambda d, w: d + w, F.max)
MIN_MAX = Semiring(float("-inf"), F.greatest, F.min)
MAX_TIMES = Semiring(1.0, lambda d, w: d * w, F.max)
