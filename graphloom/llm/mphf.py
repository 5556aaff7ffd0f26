"""Minimal perfect hashing of 64-bit keys in cascading bit arrays, in numpy."""

from __future__ import annotations

import numpy as np

LEVELS, GAMMA = 24, 2
_U = np.uint64


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    """A new 64-bit hash of the keys for each level (splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = keys + _U((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def build(keys: np.ndarray) -> list[bytes]:
    """Bit arrays of the levels for distinct uint64 keys; the last entry lists keys that no level could place.

    On each level a key that is alone at its position sets that bit and is
    done; the others go on. About three bits a key.
    """
    levels, rest = [], np.ascontiguousarray(keys, dtype=_U)
    for level in range(LEVELS):
        if not len(rest):
            break
        size = max(64, -(-GAMMA * len(rest) // 64) * 64)
        at = (_mix(rest, level) % _U(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(np.packbits(alone, bitorder="little").tobytes())
        rest = rest[~alone[at]]
    return [*levels, np.sort(rest).tobytes()]


class Lookup:
    """Index of a key in 0..n-1, or -1 for a key that is surely not of the set."""

    def __init__(self, levels: list[bytes]) -> None:
        self.words = [np.frombuffer(x, dtype="<u8") for x in levels[:-1]]
        self.rest = np.frombuffer(levels[-1], dtype="<u8")
        self.ranks, base = [], 0
        for words in self.words:
            ends = np.cumsum(np.bitwise_count(words).astype(np.int64))
            self.ranks.append(base + ends - np.bitwise_count(words))
            base += int(ends[-1])
        self.base = base

    def __len__(self) -> int:
        return self.base + len(self.rest)

    def index(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, dtype=np.int64)
        todo = np.arange(len(keys))
        for level, (words, ranks) in enumerate(zip(self.words, self.ranks, strict=True)):
            if not len(todo):
                return out
            at = _mix(keys[todo], level) % _U(64 * len(words))
            word, bit = (at >> _U(6)).astype(np.int64), at & _U(63)
            hit = (words[word] >> bit) & _U(1) == 1
            below = np.bitwise_count(words[word[hit]] & ((_U(1) << bit[hit]) - _U(1)))
            out[todo[hit]] = ranks[word[hit]] + below
            todo = todo[~hit]
        if len(todo) and len(self.rest):
            at = np.searchsorted(self.rest, keys[todo])
            hit = self.rest[np.minimum(at, len(self.rest) - 1)] == keys[todo]
            out[todo[hit]] = self.base + at[hit]
        return out
