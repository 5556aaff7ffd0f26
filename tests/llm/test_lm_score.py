"""Language-model scores against a plain backoff model, with nulls, repeated rows, long texts and clashing names."""

import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from graphloom.llm.lm_score import ESCAPE, GROWTH, _Block, _scored, lm_score

SCHEMA = "doc_id long, text string, score string, block map<string,int>"


def rows():
    out = [(i, f"The cat {i % 5} sat on\tthe mat {'ÄB ' * (i % 3)}x{i}", "s", None) for i in range(40)]
    return out + [(50, None, None, None), (51, " \n", None, None), (52, "new words only here", None, None), (None, "the cat", None, None), (3, "the cat", None, {"a": 1}), (3, "the cat", None, {"a": 1}), (60, "long run " * 3000, None, None)]


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def plain(data, order):
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    count = [Counter() for _ in range(order)]
    for i, text, *_ in data:
        if not held(i):
            w = ["<s>", *tokens(text)]
            for n in range(order):
                count[n].update(tuple(w[k - n : k + 1]) for k in range(max(1, n), len(w)))
    big_n, big_v = sum(count[0].values()), len(count[0])
    seen = lambda h: sum(c for (g), c in count[len(h)].items() if g[:-1] == h)
    cache = {}

    def p(h, w):
        if not h:
            return (count[0][(w,)] + 1) / (big_n + big_v + 1)
        if h not in cache:
            cache[h] = seen(h)
        if not cache[h]:
            return p(h[1:], w)
        e = min(1.0, ESCAPE * cache[h] ** (GROWTH - 1))
        return (1 - e) * count[len(h)][(*h, w)] / cache[h] + e * p(h[1:], w)

    out = []
    for i, text, *_ in data:
        w = ["<s>", *tokens(text)]
        score = sum(math.log10(p(tuple(w[max(0, k - order + 1) : k]), w[k])) for k in range(1, len(w)))
        base = sum(math.log10(p((), x)) for x in w[1:])
        out.append((str(i), held(i), len(w) - 1, sum(count[0][(x,)] > 0 for x in w[1:]), big_n, round(base, 6), round(score, 6)))
    return sorted(out)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores(spark, order):
    found = lm_score(spark.createDataFrame(rows(), SCHEMA).repartition(3), order)
    assert found.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert sorted((str(r[0]), *r[1:5], round(r[5], 6), round(r[6], 6)) for r in found.collect()) == plain(rows(), order)


def test_nothing_and_nothing_learned(spark):
    assert lm_score(spark.createDataFrame([], SCHEMA)).count() == 0
    found = lm_score(spark.createDataFrame([(None, "a b", None, None)], SCHEMA)).collect()
    assert [tuple(r) for r in found] == [(None, True, 3, 0, 0, 0.0, 0.0)]


def test_memory_of_a_block():
    """Two blocks of 16 MB at a time have to fit beside an executor's heap; with 8-byte numbers it was 107 bytes a token."""
    rng, size = np.random.default_rng(1), 200_000
    seq = (rng.zipf(1.2, size) % 25_000).astype(np.uint32)
    lengths = np.full(500, size // 500)
    seq[lengths.cumsum() - 1] = 0
    seq = np.unique(seq, return_inverse=True)[1].astype(np.uint32)
    hashes = np.sort(rng.integers(0, 1 << 63, int(seq.max()) + 1).astype(np.uint64))
    tracemalloc.start()
    block = _Block(hashes, lengths, seq, np.arange(500) % 7 != 2)
    totals = [np.ones(len(g["keys"]), np.int64) for g in block.ngrams(2)]
    tracemalloc.reset_peak()
    _scored(block, 2, totals, size, len(hashes))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 75 * size
