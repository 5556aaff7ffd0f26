"""Vectors in Arrow columns: checks and blocks of equal dimension."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def by_dimension(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, values) for every dimension of a list column: the numbers of the rows and one float64 matrix.

    Vectors that are null or empty, or hold null or non-finite parts, are left out.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null parts become NaN
    start = np.cumsum(lengths) - lengths
    out = []
    for width in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == width)
        x = flat[start[at][:, None] + np.arange(width)]
        good = np.isfinite(x).all(axis=1)
        if good.any():
            out.append((at[good], x[good]))
    return out
