"""The registered queries of this subpackage, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import mixing, packing, toxicity
from graphloom.llm.divergence import divergence
from graphloom.llm.embedding_dedup import embedding_dedup
from graphloom.llm.html_text import html_text
from graphloom.llm.line_dedup import line_dedup
from graphloom.llm.lm_score import lm_score
from graphloom.llm.merkle import manifest
from graphloom.llm.minhash import minhash_dedup
from graphloom.llm.token_counts import documents_token_counts
from graphloom.llm.token_files import read_token_files, write_token_files
from graphloom.llm.topk import exact_topk

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SEPARATOR = 50256


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_token_files(_table(spark, sf_dir, "documents"), TOKENIZER)
    return read_token_files(spark, manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_token_counts(_table(spark, sf_dir, "documents"), TOKENIZER, SEPARATOR).select("doc_id", "n_tokens")


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_token_files, op8_token_counts)}

SQL: dict[str, str] = {}

SQL["op1_line_dedup"] = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
each AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM docs),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM each),
often AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(o.key) AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE o.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN often o USING (key) GROUP BY r"""


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted")


QUERIES["op9_toxicity"] = op9_toxicity

#: Weights 5, 2, 1 on the mean: the first sources fade out, the second stay, the third come late.
CURRICULUM = mixing.repeating([[(0.0, 6.0), (1.0, 4.0)], 2.0, [(0.0, 0.5), (0.5, 0.75), (1.0, 2.0)]])


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer=TOKENIZER)
    return packed.select(F.col("id").alias("doc_id"), "length", "bucket", "bucket_length", "batch", "slot")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(_table(spark, sf_dir, "documents"), CURRICULUM)
    copies = mixing.positions(planned, CURRICULUM).groupBy("i", "size", "rank").agg(F.sum("size").alias("taken"), F.min("position").alias("first_position"))
    return planned.join(copies, ["i", "size", "rank"], "left").select(F.col("id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "first_position")


QUERIES |= {"op3_packing": op3_packing, "op4_mixing": op4_mixing}


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), shingle_words=4)


QUERIES["op7_minhash"] = op7_minhash


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


QUERIES["op6_html_text"] = op6_html_text


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(_table(spark, sf_dir, "embeddings"))


QUERIES["op5_embedding_dedup"] = op5_embedding_dedup
SQL["op5_embedding_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
l AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id <> b.id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.9),
r(id, c) USING KEY (id) AS (SELECT DISTINCT a, a FROM l UNION SELECT l.b, min(r.c) FROM r JOIN l ON l.a = r.id JOIN recurring.r q ON q.id = l.b WHERE r.c < q.c GROUP BY l.b)
SELECT e.vec_id, count(l.b) AS n_links, coalesce(any_value(r.c), e.vec_id) AS component_id, coalesce(any_value(r.c), e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN l ON l.a = e.vec_id LEFT JOIN r ON r.id = e.vec_id GROUP BY e.vec_id"""


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return exact_topk(vectors, vectors.where("vec_id % 50 = 0"))


QUERIES["op10_exact_topk"] = op10_exact_topk
SQL["op10_exact_topk"] = """
WITH v AS (SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda e: floor(256 * e)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (SELECT q.id AS query_id, v.id AS vec_id, list_dot_product(q.x, v.x)::BIGINT AS score FROM v q JOIN v ON q.id <> v.id AND len(q.x) = len(v.x) WHERE q.id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
QUALIFY rank <= 5"""


def op11_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(_table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    made = manifest(_table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], seen={"text": tampered})
    proof = F.sha2(F.concat_ws("", "proof"), 256).alias("proof_sha256")
    return made.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(_table(spark, sf_dir, "documents"))


QUERIES |= {"op11_lm_score": op11_lm_score, "op12_merkle_manifest": op12_merkle_manifest, "op13_source_divergence": op13_source_divergence}

#: CRC-32 of an id as decimal text, bit by bit.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: list_transform(range(8), lambda j: ((ascii(c) >> j::INTEGER) & 1)::BIGINT)))),
 lambda s, b: xor(s >> 1, CASE WHEN (xor(s, b) & 1) = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"""
_P1 = "((coalesce({0}.n, 0) + 1) / (big_n + big_v + 1))"
SQL["op11_lm_score"] = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_CRC} % 7 = 2, true) AS held_out, list_append(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''), '') AS ws FROM documents),
tok AS (SELECT r, held_out, unnest(ws) AS w, unnest(list_concat([' '], ws[:-2])) AS h FROM docs),
uni AS (SELECT w, count(*)::DOUBLE AS n FROM tok WHERE NOT held_out GROUP BY w), bi AS (SELECT h, w, count(*)::DOUBLE AS n FROM tok WHERE NOT held_out GROUP BY h, w),
his AS (SELECT h, sum(n) AS n FROM bi GROUP BY h), tot AS (SELECT coalesce(sum(n), 0) AS big_n, count(*)::DOUBLE AS big_v FROM uni),
p AS (SELECT r, uni.n > 0 AS known, log10({_P1.format('uni')}) AS base, log10(CASE WHEN his.n IS NULL THEN {_P1.format('uni')} ELSE (1 - 0.8 * pow(his.n, -0.1)) * coalesce(bi.n, 0) / his.n + 0.8 * pow(his.n, -0.1) * {_P1.format('uni')} END) AS score
 FROM tok CROSS JOIN tot LEFT JOIN uni USING (w) LEFT JOIN his USING (h) LEFT JOIN bi USING (h, w))
SELECT any_value(doc_id) AS doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(*) FILTER (known) AS n_known, (SELECT big_n::BIGINT FROM tot) AS train_tokens, fsum(base) AS base_score, fsum(score) AS score
FROM p JOIN docs USING (r) GROUP BY r"""
_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
_LEAF = "sha256({})"
_UP = "SELECT t, h + 1, i // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM {x} WHERE n > 1 GROUP BY t, h, i // 3, n"
_RUNS = "SELECT t, h, i // 3 AS i, list(d ORDER BY i) AS ds FROM {x} GROUP BY t, h, i // 3"
_WALK = """SELECT r, t, h + 1, w.i // 3, (n + 2) // 3, sha256(list_aggregate(list_concat(ds[:w.i % 3], [d], ds[w.i % 3 + 2:]), 'string_agg', '')),
 proof || coalesce(list_aggregate(list_concat(ds[:w.i % 3], ds[w.i % 3 + 2:]), 'string_agg', ''), '') FROM {w} w JOIN {x} USING (t, h) WHERE n > 1 AND {x}.i = w.i // 3"""
SQL["op12_merkle_manifest"] = f"""
WITH RECURSIVE docs AS (SELECT doc_id, source, lang, n_chars, text, CASE WHEN {_CRC} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS seen FROM documents),
hashed AS (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS t, {_LEAF.format(" || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "text")))} AS leaf,
 {_LEAF.format(" || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "seen")))} AS seen FROM docs),
leaves AS (SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY t) AS n FROM hashed),
node(t, h, i, n, d) AS (SELECT t, 0, i, n, leaf FROM leaves UNION ALL {_UP.format(x='node')}), runs AS ({_RUNS.format(x='node')}),
w(r, t, h, i, n, d, proof) AS (SELECT r, t, 0, i, n, seen, '' FROM leaves UNION ALL {_WALK.format(w='w', x='runs')}),
tops AS (SELECT t, d FROM node WHERE n = 1),
above(t, h, i, n, d) AS (SELECT 0, 0, t, (SELECT count(*) FROM tops), d FROM tops UNION ALL {_UP.format(x='above')}), upper AS ({_RUNS.format(x='above')}),
z(r, t, h, i, n, d, proof) AS (SELECT r, 0, 0, t, (SELECT count(*) FROM tops), d, proof FROM w WHERE n = 1 UNION ALL {_WALK.format(w='z', x='upper')})
SELECT l.doc_id, l.leaf, tops.d AS subroot, (SELECT d FROM above WHERE n = 1) AS root, sha256(z.proof) AS proof_sha256, z.d AS folded_root, z.d = (SELECT d FROM above WHERE n = 1) AS verified
FROM leaves l JOIN tops USING (t) JOIN z ON z.r = l.r AND z.n = 1"""

SQL["op13_source_divergence"] = r"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
k AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM words JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM docs),
tot AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total, (SELECT count(*) FROM k WHERE k.lang = g.lang)::HUGEINT AS v FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
s AS (SELECT tot.lang, tot.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (total + v) AS p FROM tot JOIN k ON k.lang = tot.lang LEFT JOIN c ON c.lang = k.lang AND c.source = tot.source AND c.term = k.term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n)::HUGEINT + 1)) // (sum(sum(n)) OVER (PARTITION BY lang)::HUGEINT + count(*) OVER (PARTITION BY lang)) AS q FROM s GROUP BY lang, term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
terms AS (SELECT s.lang, s.source, 'term' AS part, s.term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM s JOIN q ON q.lang = s.lang AND q.term = s.term WHERE n > 0 AND p > q),
r AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM r WHERE part = 'pair' OR rank <= 200"""
