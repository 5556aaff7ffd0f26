"""Plain Python versions of parts of the operators, written apart from them."""

from collections import Counter, defaultdict


def targets(sizes, weight, most=3):
    """{source: target}; sources by code point, None last; weight(i) is the mean weight of source number i."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    share = {s: weight(i) for i, s in enumerate(order)}
    capped, left = {}, float(sum(sizes.values()))
    while True:
        free = [s for s in order if s not in capped]
        total = sum(share[s] for s in free)
        give = {s: left * share[s] / total if total else 0.0 for s in free}
        over = [s for s in free if give[s] > most * sizes[s]]
        if not over:
            return capped | give
        for s in over:
            capped[s] = float(most * sizes[s])
            left -= capped[s]


def copies(docs, weight, most=3):
    """Counter of (source, size, times a document is taken) for docs (source, size)."""
    sizes, by_size, out = Counter(), defaultdict(Counter), Counter()
    for s, z in docs:
        sizes[s] += z
        by_size[s][z] += 1
    for s, target in targets(sizes, weight, most).items():
        whole = min(int(target // sizes[s]), most) if sizes[s] else 0
        share = target / sizes[s] - whole if sizes[s] and whole < most else 0.0
        due = taken = 0
        for z in sorted(by_size[s], reverse=True):
            n = by_size[s][z]
            due += share * z * n
            more = min(n, max(0, int((due - taken) / z + 0.5))) if z else 0
            taken += more * z
            out[s, z, whole] += n - more
            out[s, z, whole + 1] += more
    return +out


def least_padding(lengths, buckets):
    """The least padding of all ways to put documents into buckets by length."""
    cells = sorted(Counter(lengths).items())
    cost = lambda i, j: sum((cells[j - 1][0] - x) * n for x, n in cells[i:j])
    best = [0] + [float("inf")] * len(cells)
    for _ in range(buckets):
        best = [min([best[j], *(best[i] + cost(i, j) for i in range(j))]) for j in range(len(cells) + 1)]
    return best[-1]


def ngrams(text, buckets=1 << 18):
    """Hashed character 3- to 5-grams of a text in lower case with single spaces, by the letter."""
    t = f" {' '.join(text.lower().split())} "
    out = set()
    for n in (3, 4, 5):
        for i in range(len(t) - n + 1):
            h = 0
            for c in t[i : i + n]:
                h = (h + ord(c)) * 0x9E3779B1 % 2**32
            out.add(((h ^ h >> 15) * 0x85EBCA6B % 2**32) >> 14)
    assert all(x < buckets for x in out)
    return out
