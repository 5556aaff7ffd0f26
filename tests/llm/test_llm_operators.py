"""Every operator against brute force on a fixture with nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import math
import operator
import string
import zlib
from collections import Counter
from fractions import Fraction

import corpus_pipeline
import numpy as np
import plain
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm import mixing, packing, toxicity
from graphloom.llm.embedding_dedup import embedding_dedup
from graphloom.llm.html_text import html_text
from graphloom.llm.line_dedup import line_dedup
from graphloom.llm.minhash import minhash_dedup
from graphloom.llm.queries import op3_packing
from graphloom.llm.token_counts import documents_token_counts, token_counts, write_flat_files
from graphloom.llm.token_files import TokenFile, read_token_files, write_token_files
from graphloom.llm.topk import exact_topk

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, score string"


def fixture():
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(400)]
    rows, base = [], " ".join(rng.choice(words, 120))
    for i in range(40):
        body = " ".join(rng.choice(words, rng.integers(1, 60)))
        lines = [body, "  Common LINE here\t" if i % 2 else "unique %d" % i, "rare line" if i < 5 else "x%d" % i]
        rows.append([i, "\n".join(lines), "en", f"s{i % 4}" if i % 7 else None])
    for i in range(40, 70):  # near copies around one text
        w = base.split(" ")
        for at in rng.choice(len(w), rng.integers(0, 6), replace=False):
            w[at] = "z%d" % rng.integers(0, 99)
        rows.append([i, " ".join(w), "de", "s1"])
    rows += [[70, None, None, None], [71, "", "en", "s0"], [72, " \n\t\n ", "en", "s0"], [73, "one", "en", "s0"], [74, "ONE", "en", "s0"], [75, " ".join(rng.choice(words, 30_000)), "en", "s2"], [76, "É common line HERE\ncommon line here\n", "fr", "é"], [None, base, "en", "s3"], [77, "a  b\n c<|endoftext|>", "en", "s3"], [77, "a  b\n c<|endoftext|>", "en", "s3"]]
    return [(*r, len(r[1] or ""), 1, "s") for r in rows]


@pytest.fixture(scope="module")
def rows():
    return fixture()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def key(line):
    return line.strip(SPACE).translate(LOWER)


def test_line_dedup(docs, rows, none):
    for least in (2, 10):
        seen = Counter()
        for r in rows:
            seen.update({key(x) for x in (r[1] or "").split("\n")})
        want = Counter()
        for r in rows:
            lines = (r[1] or "").split("\n")
            kept = [x for x in lines if not key(x) or seen[key(x)] < least]
            want[r[0], "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
        out = line_dedup(docs, min_docs=least)
        assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
        assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect()) == want
    assert line_dedup(none).count() == 0


NAMES = "row row2 doc print hits id _doc _hits _row _id _hash _place _pid _v _o0 _position shard copy h1 h2 part".split()


def test_names_of_other_columns(docs, rows):
    wide = docs.drop("shard").withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in NAMES})
    values = lambda df: Counter(map(tuple, df.select("doc_id", *NAMES).collect()))
    have = values(wide)
    out = line_dedup(wide)
    assert out.columns == [*wide.columns, "n_lines", "n_dropped"] and values(out) == have
    out = packing.pack_documents(wide)
    assert out.columns == [*wide.columns, "length", "bucket", "bucket_length", "batch", "slot"] and values(out) == have
    out = mixing.mix(wide, mixing.repeating([1.0]))
    assert out.columns == [*wide.columns, "position"] and set(values(out)) <= set(have)
    assert values(corpus_pipeline.without_near_copies(wide.sparkSession, wide, "")).keys() <= have.keys()
    assert values(toxicity.score(wide, toxicity.Model(np.zeros(toxicity.BUCKETS), 0.0))) == have


def test_rows_without_id_and_repeated_rows_keep_their_own_lines(spark):
    docs = spark.createDataFrame([(None, f"common\nown {i}") for i in range(30)] + [(7, "common\nx")] * 3 + [(7, "y\ncommon")], "doc_id long, text string")
    out = Counter((r["doc_id"], r["text"], r["n_dropped"]) for r in line_dedup(docs).collect())
    assert out == Counter({**{(None, f"own {i}", 1): 1 for i in range(30)}, (7, "x", 1): 3, (7, "y", 1): 1})


def test_token_files(spark, docs, rows, none):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    want, start = [], 0
    for r in order:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    manifest = write_token_files(docs, TOKENIZER)
    out = sorted((tuple(r)[2:] for r in read_token_files(spark, manifest).collect()), key=lambda r: r[1])
    assert out == want
    file = TokenFile(manifest.orderBy("part").first()["path"])
    first = [x for _, _, x in file.documents()]
    assert all((file.document(i) == x).all() for i, x in enumerate(first))
    some = list(file.documents(2, 5))
    assert [i for i, _, _ in some] == [2, 3, 4] and all((x == first[i]).all() for i, _, x in some)
    wild = [(-(2**63), "a"), (2**63 - 1, "b c"), (5, "d"), (None, "e"), (None, None)]
    back = read_token_files(spark, write_token_files(spark.createDataFrame(wild, "doc_id long, text string"), TOKENIZER, partitions=1))
    assert [r["doc_id"] for r in back.orderBy("number").collect()] == [None, None, -(2**63), 5, 2**63 - 1]
    assert read_token_files(spark, write_token_files(none, TOKENIZER)).count() == 0


def test_token_counts(docs, rows, none):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    tokenizer.encode_special_tokens = True
    want = Counter((r[0], len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in documents_token_counts(docs, TOKENIZER, 50256).collect()) == want
    files, order = write_flat_files(docs, TOKENIZER, 50256)
    whole = {(r["path"], r["number"]): (r["start"], r["n_tokens"]) for r in token_counts(files, 50256).collect()}
    for block in (64, 1000):  # documents over many blocks, blocks of many documents
        assert {(r["path"], r["number"]): (r["start"], r["n_tokens"]) for r in token_counts(files, 50256, block).collect()} == whole
    assert documents_token_counts(none, TOKENIZER, 50256).count() == 0


def test_packing(docs, rows, none):
    out = packing.pack(docs, buckets=5, budget=300).collect()
    assert Counter(r["id"] for r in out) == Counter(r[0] for r in rows)
    size = {r[0]: len((r[1] or "").encode().split()) for r in rows}
    batches = {}
    for r in out:
        assert r["length"] == size[r["id"]] <= r["bucket_length"]
        batches.setdefault((r["bucket"], r["batch"]), []).append(r)
    for (bucket, _), members in batches.items():
        room = max(1, 300 // max(1, members[0]["bucket_length"]))
        assert len(members) <= room and sorted(m["slot"] for m in members) == list(range(len(members)))
    for bucket in {b for b, _ in batches}:
        short = [k for k, m in batches.items() if k[0] == bucket and len(m) < max(1, 300 // max(1, m[0]["bucket_length"]))]
        assert len(short) <= 1
    assert sum(r["bucket_length"] - r["length"] for r in out) == plain.least_padding([r["length"] for r in out], 5)
    assert Counter(r["text"] for r in packing.pack_documents(docs).collect()) == Counter(r[1] for r in rows)
    assert packing.pack(none).count() == 0 and packing.pack_documents(none).count() == 0


def test_packing_counts_tokens(spark, docs, rows, none, tmp_path):
    junk = [(1, "0f3a9c7e" * 4000), (2, "河边的小镇" * 500), (3, "a b"), (4, ""), (5, None), (6, "c")]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(junk, "doc_id long, text string").write.parquet(path)
    encode = Tokenizer.from_file(TOKENIZER).encode
    size = {i: len(encode(t or "", add_special_tokens=False).ids) for i, t in junk}
    assert size[1] > 8000 and size[2] > 1000
    for out in (op3_packing(spark, str(tmp_path)).collect(), corpus_pipeline.packed(spark, spark.read.parquet(path), "").collect()):
        assert {r["doc_id"]: r["length"] for r in out} == size and len(out) == len(junk)
        batches = Counter()
        for r in out:
            batches[r["bucket"], r["batch"]] += r["length"]
        alone = Counter((r["bucket"], r["batch"]) for r in out)
        assert all(n <= 16_384 or alone[b] == 1 for b, n in batches.items())
    big = {r["id"]: r["length"] for r in packing.pack(docs, budget=300, tokenizer=TOKENIZER).collect()}
    assert big == {r[0]: len(encode(r[1] or "", add_special_tokens=False).ids) for r in rows}
    assert packing.pack(none, tokenizer=TOKENIZER).count() == 0


def test_mixing(spark, docs, rows, none):
    weights = mixing.repeating([[(0.0, 6.0), (1.0, 4.0)], 2.0, 1.0])
    planned = mixing.plan(docs, weights)
    again = sorted(map(tuple, mixing.plan(docs.repartition(3), weights).collect()), key=repr)
    out = planned.collect()
    assert sorted(map(tuple, out), key=repr) == again and len(out) == len(rows)
    sized = [(r[3], len((r[1] or "").encode().split())) for r in rows]
    sizes = Counter()
    for s, n in sized:
        sizes[s] += n
    want = plain.targets(sizes, lambda i: (5.0, 2.0, 1.0)[i % 3])
    assert Counter((r["source"], r["size"], r["repeats"]) for r in out) == plain.copies(sized, lambda i: (5.0, 2.0, 1.0)[i % 3])
    assert all(r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 for r in out)
    taken = Counter()
    for r in out:
        taken[r["source"]] += r["size"] * r["repeats"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(n for x, n in sized if x == s)
    # a copy's position is where the integral of its source's schedule meets its share of the source's words
    for r in mixing.positions(planned, weights).toPandas().sort_values("position").groupby("i"):
        i, copies = r
        before, total = 0, copies["size"].sum()
        for size, position in zip(copies["size"], copies["position"], strict=True):
            w0, w1 = ((6.0, 4.0), (2.0, 2.0), (1.0, 1.0))[i % 3]
            met = (w0 * position + (w1 - w0) * position**2 / 2) / ((w0 + w1) / 2)
            assert abs(met - (before + size / 2) / total) < 1e-9
            before += size
    mixed = mixing.mix(docs, weights)
    at = mixed.select("position").collect()
    assert [x[0] for x in at] == sorted(x[0] for x in at) and all(0 <= x[0] <= 1 for x in at)
    assert len(at) == sum(r["repeats"] for r in out if r["size"])
    assert mixing.mix(none, weights).count() == 0


def test_mixing_follows_the_schedule(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.when(F.col("id") % 2 == 0, "early").otherwise("late").alias("source"))
    weights = mixing.repeating([[(0.0, 2.0), (1.0, 0.0)], [(0.0, 0.0), (1.0, 2.0)]])
    mixed = mixing.mix(docs, weights).select("source", "position").toPandas()
    first = mixed[mixed["position"] < 0.25]["source"].value_counts(normalize=True)
    assert abs(first["early"] - 0.875) < 0.03


def links(sets, percent=80):
    par = list(range(len(sets)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                par[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("k", [4, 5])
def test_minhash(docs, rows, none, k):
    def shingles(text):
        w = (text or "").encode().translate(bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())).split()
        return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    known = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    sets = [shingles(r[1]) for r in known]
    root = links(sets)
    want = Counter((r[0], len(s), known[root[i]][0], known[root[i]][0] == r[0]) for i, (r, s) in enumerate(zip(known, sets, strict=True)))
    want[None, len(shingles(next(r[1] for r in rows if r[0] is None))), None, True] += 1
    out = Counter(map(tuple, minhash_dedup(docs, shingle_words=k).select("doc_id", "n_shingles", "component_id", "kept").collect()))
    assert out == want
    assert minhash_dedup(none).count() == 0


def test_minhash_over_several_tiles(spark, monkeypatch):
    from graphloom.llm import minhash

    monkeypatch.setattr(minhash, "TILE", 9000)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(60):
        w = list(base)
        for at in rng.choice(len(w), rng.integers(0, 9), replace=False):
            w[at] = f"z{rng.integers(0, 999)}"
        rows.append((i, " ".join(w)))
    sets = [{tuple(t.split()[i : i + 4]) for i in range(147)} for _, t in rows]
    want = [(i, x) for i, x in enumerate(links(sets))]
    out = minhash_dedup(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=4)
    assert sorted((r["doc_id"], r["component_id"]) for r in out.collect()) == want


def test_toxicity(spark, none):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abdefghiklmnoprstu"), rng.integers(3, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(900):
        w = list(rng.choice(words, rng.integers(5, 60)))
        y = int(rng.random() < 0.3)
        if y:
            w.insert(int(rng.integers(0, len(w))), str(rng.choice(["vexzoq", "quibjax"])))
        rows.append((i, " ".join(w), y))
        labels.append((i, 1, y))
    docs = spark.createDataFrame([(i, t, i) for i, t, _ in rows] + [(9001, None, 0), (9002, "", 0), (None, "vexzoq " * 50_000, 0)], "doc_id long, text string, score long")
    label = spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, label)
    out = toxicity.score(docs, model).withColumn("held_out", toxicity.held_out("doc_id")).collect()
    assert len(out) == 903 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    truth = {i: y for i, _, y in rows}
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert held and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    # counts, scales, optimum and scores once more, by the letter
    learned = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5 and i != 5] + [(rows[5][1], rows[5][2])] * (zlib.crc32(b"5") % 5 > 0)
    sets = [plain.ngrams(t) for t, _ in learned]
    n1 = sum(y for _, y in learned)
    n0 = len(learned) - n1
    count = Counter((f, y) for s, (_, y) in zip(sets, learned, strict=True) for f in s)
    scale = {}
    for f in {f for f, _ in count}:
        scale[f] = math.log((count[f, 1] + 1) / (n1 + 2) / ((count[f, 0] + 1) / (n0 + 2)))
    assert set(np.flatnonzero(model.weights)) <= set(scale)
    slope = Counter()
    for s, (_, y) in zip(sets, learned, strict=True):
        z = model.bias + sum(model.weights[f] for f in s)
        pull = y - 1 / (1 + math.exp(-z))
        for f in s:
            slope[f] += pull * scale[f]
    # at the optimum 10 * weight / scale is the sum of the pulls on a feature; the descent ends a little before
    off = [10 * model.weights[f] / scale[f] - slope[f] for f in scale if scale[f]]
    assert np.linalg.norm(off) <= 0.1 * np.linalg.norm(list(slope.values())) and 0 <= model.gap < toxicity.GAP
    by_id = {r["doc_id"]: r["score"] for r in out}
    for i, t, _ in rows[:50]:
        assert abs(by_id[i] - 1 / (1 + math.exp(model.mark - model.bias - sum(model.weights[f] for f in plain.ngrams(t))))) < 1e-9
    # held-out labels change nothing
    flipped = label.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert np.allclose(toxicity.fit(docs, flipped).weights, model.weights, atol=1e-9)
    few = toxicity.fit(docs, label, max_fit_bytes=20_000)  # some twenty texts: another model, within its bound
    assert not np.allclose(few.weights, model.weights, atol=1e-9)
    assert toxicity.score(none, model).count() == 0
    assert toxicity.fit(docs, label.limit(0)).score(np.zeros(0, dtype=int)) == 0.5
    assert toxicity.fit(docs, label.where("toxic = 0")).score(np.zeros(0, dtype=int)) == 0.0


def test_mark():
    y = np.array([1, 1, 0, 1, 0, 0, 0, 0])
    assert 1.0 < toxicity.mark(np.array([5.0, 4.0, 1.0, 0.5, -1.0, -2.0, -3.0, -4.0]), y) < 4.0  # no clean one may be lost of so few
    assert toxicity.mark(np.array([3.0, 1.0]), np.array([1, 0])) == 2.0
    z = np.concatenate([np.full(1, 1.5), np.full(400, -2.0), [1.0] * 50, [9.0] * 50])
    assert toxicity.mark(z, np.array([0] * 401 + [1] * 100)) < 1.0  # one clean one in 401 is let go for fifty toxic ones


def test_a_fit_that_does_not_settle_is_an_error(monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_ROUNDS", 4)
    monkeypatch.setattr(toxicity, "GAP", 0.0)
    with pytest.raises(RuntimeError, match="not settled"):
        toxicity.descend([np.array([0, 1]), np.array([1, 2])], np.array([1.0, 0.0]), np.array([1.0, 0.1, -1.0]), 10.0)


def vectors():
    rng = np.random.default_rng(11)
    rows = [(i, rng.standard_normal(16).tolist(), 0) for i in range(150)]
    for i in range(150, 260):  # a hot group and some pairs
        near = np.array(rows[3 if i < 230 else i - 230][1]) + rng.standard_normal(16) * 0.1
        rows.append((i, near.tolist(), 1))
    rows += [(300, None, 0), (301, [0.0] * 16, 0), (302, [1.0] * 15 + [None], 0), (303, [1.0] * 15 + [float("nan")], 0), (304, [1.0] * 15 + [float("inf")], 0), (305, [1.0, 2.0], 0), (306, [2.0, 4.0], 0), (307, rows[0][1], 0), (308, [], 0), (None, rows[0][1], 0)]
    one = np.array(rows[1][1])
    rows += [(310 + i, (one * f).tolist(), 0) for i, f in enumerate((1e200, -1e200, 1e-200, 3e-200, 1e308 / np.abs(one).max(), 1e8, 5e-324 / np.abs(one).max()))]
    return rows


@pytest.mark.parametrize("values", [1 << 21, 640])
def test_embedding_dedup(spark, values):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int")
    good = {i: np.ldexp(v, -int(np.frexp(np.abs(v).max())[1])) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = sorted(good)
    near = {i: [j for j in ids if j != i and len(good[i]) == len(good[j]) and good[i] @ good[j] >= 0.9 * np.linalg.norm(good[i]) * np.linalg.norm(good[j])] for i in ids}
    root = {}
    for i in ids:
        if i not in root:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in root:
                    root[x] = i
                    todo += near[x]
    want = Counter((i, len(near.get(i, [])), root.get(i, i), root.get(i, i) == i if i is not None else True) for i, _, _ in rows)
    assert Counter(map(tuple, embedding_dedup(df, block_dims=4, tile_values=values).collect())) == want
    assert embedding_dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("subtree", [4096, 20])
def test_exact_topk(spark, subtree):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    good = {i: [math.floor(256 * Fraction(x)) for x in v] for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    want = set()
    for q in (i for i in good if i % 5 == 0):
        found = sorted((-sum(map(operator.mul, good[q], x)), i) for i, x in good.items() if i != q and len(x) == len(good[q]))[:5]
        want |= {(q, k + 1, i, max(-(2**63), min(2**63 - 1, -s))) for k, (s, i) in enumerate(found)}
    out = exact_topk(df, df.where("vec_id % 5 = 0"), page=16, subtree=subtree, query_block=16)
    assert {tuple(r) for r in out.collect()} == want
    assert exact_topk(df.limit(0), df.limit(0)).count() == 0 and exact_topk(df, df.limit(0)).count() == 0


def test_html_text(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>Text &amp;\n more</p></article>", "x"), (2, None, None, None), (3, "v", "", None), (3, "v", "", None), (4, "w", "<article><p>" + "word " * 200_000 + "</p></article>", None)], "page_id long, url string, html string, TEXT string")
    out = {(r["page_id"], r["text"], r["n_chars"]) for r in html_text(pages).select("page_id", "text", "n_chars").collect()}
    assert out == {(1, "Text & more", 11), (2, "", 0), (3, "", 0), (4, ("word " * 200_000).strip(), 999_999)}
    assert html_text(pages).count() == 5 and html_text(pages.limit(0)).count() == 0


def test_kept_digest(docs):
    r = line_dedup(docs, min_docs=10).where("doc_id = 70").select(F.sha2("text", 256).alias("h")).first()
    assert r["h"] == hashlib.sha256(b"").hexdigest()
