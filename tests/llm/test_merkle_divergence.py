"""The Merkle manifest and the divergence audit against plain Python, with nulls, ties, repeated rows and clashing names."""

import hashlib
import re
import string
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom.llm import divergence as audit
from graphloom.llm.divergence import divergence
from graphloom.llm.merkle import fold, joined, manifest

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf int, term map<string,int>"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def table():
    rows = [(i, f"a b\nWord{i % 4} Straße {'x' * (i % 3)}\n", "en" if i % 3 else "de", "web" if i % 2 else "Book", i, i, {"a": i}) for i in range(28)]
    rows += [(3, "tie", "en", "web", None, 0, None), (3, "tie", "en", "web", None, 0, None), (3, "other", "en", "web", 1, 0, None)]
    rows += [(40, None, None, None, None, None, None), (None, "no id\n", "de", None, 2, 1, None), (41, "", "", "", 0, 1, None), (42, "alone " * 4000, "fr", "é", 9, 1, None)]
    return [r[:5] + r[5:] for r in rows]


def leaf(row, text):
    at = dict(zip(SCHEMA.replace("map<string,int>", "map").split(", "), row))
    at = {k.split()[0]: v for k, v in at.items()} | {"text": text}
    return sha("".join("-" if at[c] is None else f"{len(str(at[c]).encode())}:{at[c]}" for c in FIELDS))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def way(of, i):
    """Siblings by level, and the places."""
    out = []
    for nodes in of[:-1]:
        run = nodes[i // 3 * 3 : i // 3 * 3 + 3]
        out.append((i % 3, run[: i % 3] + run[i % 3 + 1 :]))
        i //= 3
    return out


def plain_manifest(rows):
    trees = defaultdict(list)
    for r in rows:
        cut = r[1].replace("\n", "") if r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[1]
        trees[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, cut), r[0]))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: levels([x[2] for x in sorted(trees[s])]) for s in names}
    upper = levels([built[s][-1][0] for s in names])
    out = Counter()
    for n, s in enumerate(names):
        for i, (_, _, own, seen, doc_id) in enumerate(sorted(trees[s])):
            steps = way(built[s], i) + way(upper, n)
            for place, others in steps:
                seen = sha("".join([*others[:place], seen, *others[place:]]))
            out[doc_id, own, built[s][-1][0], upper[-1][0], sha("".join(d for _, others in steps for d in others)), seen] += 1
    return out


def made(df):
    cut = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    out = manifest(df, FIELDS, seen={"text": cut})
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(F.concat_ws("", "proof"), 256), "folded_root", "proof", "places", "runs")


def test_manifest(spark):
    rows = table() + [(i, f"line {i}\n", "en", "web" if i % 5 else f"s{i % 30}", i, 0, None) for i in range(100, 560)]
    found = made(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert Counter(tuple(r)[:6] for r in found) == plain_manifest(rows)
    for r in found:  # the proof that is returned leads from the leaf to the root
        digests, steps = [bytes.fromhex(d) for d in r["proof"]], []
        for place, n in zip(r["places"], r["runs"]):
            steps.append((place, tuple(digests[:n])))
            digests = digests[n:]
        assert not digests and fold(bytes.fromhex(r["leaf"]), tuple(steps)).hex() == r["root"]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 10])
def test_small_manifests(spark, n):
    one = [(i, f"t{i}\n", "en", "web", 1, 1, None) for i in range(n)]
    many = [(i, f"t{i}\n", "en", f"s{i}", 1, 1, None) for i in range(n)]
    for rows in (one, many):
        assert Counter(tuple(r)[:6] for r in made(spark.createDataFrame(rows, SCHEMA)).collect()) == plain_manifest(rows)


def test_joined_is_over_hex_text():
    a, b = hashlib.sha256(b"a").digest(), hashlib.sha256(b"b").digest()
    assert joined([a, b]).hex() == sha(a.hex() + b.hex())


def plain_divergence(rows, least, most):
    terms, of_lang, groups = defaultdict(Counter), defaultdict(Counter), set()
    for r in rows:
        text, lang, source = (r[1] or "").translate(LOWER), r[2] or "", r[3] or ""
        groups.add((lang, source))
        here = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text))
        terms[lang, source] += here
        of_lang[lang].update(set(here))
    kept = {lang: sorted(t for t, n in c.items() if n >= least) for lang, c in of_lang.items()}
    shares = {}
    for lang in {g[0] for g in groups}:
        own = [g for g in groups if g[0] == lang]
        whole = sum((terms[g] for g in own), Counter())
        for g, c in [*((g, terms[g]) for g in own), ((lang, None), whole)]:
            v, n = len(kept.get(lang, [])), sum(c[t] for t in kept.get(lang, []))
            shares[g] = {t: 1 + 10**9 * (c[t] + 1) // (n + v) for t in kept.get(lang, [])}
    f = lambda p, q: (p - q) ** 2 // q
    out = set()
    for lang, source in groups:
        pair = [(sum(f(shares[lang, source][t], shares[g][t]) for t in kept.get(lang, [])), g[1]) for g in groups if g[0] == lang and g[1] != source]
        term = [(f(p, shares[lang, None][t]), t) for t, p in shares[lang, source].items() if terms[lang, source][t] and p > shares[lang, None][t]]
        for part, items in (("pair", pair), ("term", term)):
            for rank, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode())), 1):
                if part == "pair" or rank <= most:
                    out.add((lang, source, part, item, value, rank))
    return out


@pytest.mark.parametrize(("least", "most", "gathered"), [(3, 200, 1_000_000), (1, 2, 10), (2, 1, 4)])
def test_divergence(spark, monkeypatch, least, most, gathered):
    monkeypatch.setattr(audit, "GATHERED", gathered)
    rows = table() + [(i, f"Ünder_score x{i} tail {'Ça ' * i}", "fr" if i % 2 else "en", f"s{i % 5}", 1, 1, None) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = [tuple(r) for r in divergence(df, least, most).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(found) == len(set(found)) and set(found) == plain_divergence(rows, least, most)


def test_divergence_of_nothing(spark):
    assert divergence(spark.createDataFrame([], SCHEMA)).count() == 0
    bare = [(1, None, "en", None, 1, 1, None), (2, "1 2 3", "en", "b", 1, 1, None), (3, "rare", "de", "b", 1, 1, None)]
    found = {tuple(r) for r in divergence(spark.createDataFrame(bare, SCHEMA)).collect()}
    assert found == {("en", "", "pair", "b", 0, 1), ("en", "b", "pair", "", 0, 1)}
