"""graph6 and sparse6 lines to and from arrays, a chunk of the line at a time; a line is one task's."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Characters that are taken at a time, by six so that pairs of any width end with a character.
CHUNK = 6 << 16


def _line(head: str, body: np.ndarray) -> pa.RecordBatch:
    """One row (line); body: characters after room for the head."""
    body[: len(head)] = np.frombuffer(head.encode(), np.uint8)
    line = pa.StringArray.from_buffers(1, pa.py_buffer(np.array([0, len(body)], np.int32)), pa.py_buffer(body))
    return pa.RecordBatch.from_arrays([line], ["line"])


def graph6_line(n: int, head: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (src, dst), src < dst, to the line; negative ones are no edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        body = np.full(len(head) + (n * (n - 1) // 2 + 5) // 6, 63, np.uint8)
        for batch in batches:
            s, d = (batch.column(c).to_numpy() for c in ("src", "dst"))
            k = (d * (d - 1) // 2 + s)[s >= 0]
            np.add.at(body, len(head) + k // 6, np.left_shift(1, 5 - k % 6).astype(np.uint8))
        yield _line(head, body)

    return run


def sparse6_line(n: int, head: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (src, dst), src < dst, to the line; negative ones are no edge."""
    k = max(1, (n - 1).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, d = (np.concatenate(x) for x in zip(*((b.column("src").to_numpy(), b.column("dst").to_numpy()) for b in batches if len(b))))
        s, d = s[s >= 0], d[s >= 0]
        order = np.lexsort((s, d))
        s, d = s[order], d[order]
        step = np.diff(d, prepend=0)
        units = np.where(step <= 1, 1, 2)  # a jump takes a pair of its own
        at = np.cumsum(units) - 1
        b, x = np.zeros(units.sum(), np.int64), np.zeros(units.sum(), np.int64)
        b[at], x[at] = np.where(step <= 1, step, 0), s
        b[at[step > 1] - 1], x[at[step > 1] - 1] = 1, d[step > 1]
        pairs, parts = (b << k) | x, [np.zeros(len(head), np.uint8)]
        pad = -(len(pairs) * (k + 1)) % 6
        fill = np.ones(pad, np.uint8)
        if pad > k and k < 6 and n == 1 << k and len(d) and d[-1] == n - 2:
            fill[0] = 0  # ones alone would read as a loop at n - 1
        places = np.arange(k, -1, -1)
        for i in range(0, len(pairs), CHUNK):
            bits = (pairs[i : i + CHUNK, None] >> places & 1).astype(np.uint8).ravel()
            bits = np.r_[bits, fill] if i + CHUNK >= len(pairs) else bits
            parts.append((bits.reshape(-1, 6) << np.arange(5, -1, -1, dtype=np.uint8)).sum(axis=1, dtype=np.uint8) + np.uint8(63))
        yield _line(head, np.concatenate(parts))

    return run


def _sized(text: np.ndarray) -> tuple[int, np.ndarray]:
    """The number of vertices, and the characters after it less 63."""
    marks = 2 if bytes(text[:2]) == b"~~" else 1 if bytes(text[:1]) == b"~" else 0
    size = (1, 3, 6)[marks]
    n = 0
    for c in text[marks : marks + size].tolist():
        n = n * 64 + c - 63
    return n, text[marks + size :]


def _graph6_edges(n: int, body: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i in range(0, len(body), CHUNK):
        value = body[i : i + CHUNK] - np.uint8(63)
        held = np.flatnonzero(value)
        for bit in range(6):
            k = (held[value[held] >> (5 - bit) & 1 == 1] + i) * 6 + bit
            d = np.floor((1 + np.sqrt(1 + 8 * k)) / 2).astype(np.int64)
            d -= d * (d - 1) // 2 > k
            d += d * (d + 1) // 2 <= k
            yield (k - d * (d - 1) // 2)[d < n], d[d < n]


def _sparse6_edges(n: int, body: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The current vertex is the sum of all b so far plus the largest x less the sum of b at x, both carried from chunk to chunk."""
    k = max(1, (max(n - 1, 1)).bit_length())
    left, total, most = np.zeros(0, np.uint8), 0, 0
    step = CHUNK // 6 * (k + 1)
    for i in range(0, len(body), step):
        value = body[i : i + step] - np.uint8(63)
        bits = (value[:, None] >> np.arange(5, -1, -1, dtype=np.uint8) & 1).ravel()
        bits = np.r_[left, bits]
        pairs = len(bits) // (k + 1)
        left, bits = bits[pairs * (k + 1) :], bits[: pairs * (k + 1)].reshape(pairs, k + 1)
        if not pairs:
            continue
        x = bits[:, 1:] @ (1 << np.arange(k - 1, -1, -1, dtype=np.int64))
        sums = np.cumsum(bits[:, 0], dtype=np.int64) + total
        above = np.maximum.accumulate(np.r_[most, x - sums])
        v = sums + above[:-1]
        total, most = int(sums[-1]), int(above[-1])
        edge = (x <= v) & (v < n)
        yield x[edge], v[edge]


def edges_of_lines(prefix: bytes, sparse: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (graph, line) to rows (graph, n, src, dst)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for graph, line in zip(batch.column("graph"), batch.column("line")):
                text = np.frombuffer(line.as_buffer(), np.uint8)
                text = text[re.match(prefix, bytes(text[:20])).end() :]
                n, body = _sized(text)
                for s, d in _sparse6_edges(n, body) if sparse else _graph6_edges(n, body):
                    yield pa.RecordBatch.from_arrays([pa.repeat(graph, len(s)), pa.array(np.full(len(s), n, np.int64)), pa.array(s), pa.array(d)], ["graph", "n", "src", "dst"])

    return run
