"""How far the sources of a language lie apart in their words: counts and partial sums by DuckDB in shards, merged by Spark.

1. Each task counts terms of its rows in DuckDB, over the Arrow batches that it
   reads, and packs the counts by shard; a shard is a hash of (language, term).
2. Each shard adds up what came for it in DuckDB and keeps the terms of enough
   documents. A term is one row for each task and source at most, however often
   it occurs, so a very common word is no heavier than another.
3. Totals by group are joined to the kept counts, and the shards, dealt anew by
   language and term, make partial sums in DuckDB: for pairs of sources over the
   terms that both have, a histogram of the shares of each source, and the
   highest terms of each source.
4. Spark merges them. Terms that a source lacks all have one share p0, so with
   f(p, q) of the contract the sum over all V terms of a pair is
     sum over terms of both  f(s, t) - f(s, t0) - f(s0, t) + f(s0, t0)
   + sum over terms of s     f(s, t0) - f(s0, t0)
   + sum over terms of t     f(s0, t) - f(s0, t0)
   + V f(s0, t0),
   whose middle lines need the histograms only.

All arithmetic is on integers: 64 bits for shares and f, 128 bits for sums.
"""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.batches import bounded
from graphloom.plans import save, shuffle_partitions

#: Letters of ASCII and all that is not ASCII.
TERM = "[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
SCALE = 1_000_000_000
#: Rows of counts that a task gathers before it packs them, and memory of its DuckDB, beyond which that spills to the task's own disk.
GATHERED, MEMORY = 1_000_000, "400MB"

_OF_BATCH = f"""
WITH words AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '{TERM}')) AS term FROM batch),
of_row AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY r, lang, source, term)
SELECT lang, source, term, sum(n)::BIGINT AS n, count(*)::BIGINT AS docs FROM of_row GROUP BY lang, source, term"""
_ADDED = "SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM counts GROUP BY lang, source, term"
_KEPT = """
WITH s AS (SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM counts GROUP BY lang, source, term),
k AS (SELECT lang, term, min(source) AS first FROM s GROUP BY lang, term HAVING sum(docs) >= $1)
SELECT s.lang, s.source, s.term, s.n, s.source = k.first AS first FROM s JOIN k ON k.lang = s.lang AND k.term = s.term"""
_SHARES = f"""
CREATE TABLE k AS SELECT lang, source, term, n, n_lang, v,
 (1 + ({SCALE}::HUGEINT * (n + 1)) // (n_group::HUGEINT + v))::BIGINT AS p, (1 + {SCALE}::HUGEINT // (n_group::HUGEINT + v))::BIGINT AS p0 FROM rows"""
_F = "(({p} - {q}) * ({p} - {q})) // {q}"
_PARTS = f"""
SELECT 'pair' AS part, a.lang, a.source, b.source AS item, sum({_F.format(p='a.p', q='b.p')} - {_F.format(p='a.p', q='b.p0')} - {_F.format(p='a.p0', q='b.p')} + {_F.format(p='a.p0', q='b.p0')})::DECIMAL(38, 0) AS value, NULL::BIGINT AS p, NULL::BIGINT AS terms
 FROM k a JOIN k b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
UNION ALL SELECT 'share', lang, source, NULL, NULL, p, count(*) FROM k GROUP BY lang, source, p
UNION ALL SELECT 'term', lang, source, term, value, NULL, NULL FROM (
 SELECT k.lang, k.source, k.term, ({_F.format(p='k.p', q='t.q')})::DECIMAL(38, 0) AS value
 FROM k JOIN (SELECT lang, term, (1 + ({SCALE}::HUGEINT * (sum(n)::HUGEINT + 1)) // (any_value(n_lang)::HUGEINT + any_value(v)))::BIGINT AS q FROM k GROUP BY lang, term) t ON t.lang = k.lang AND t.term = k.term WHERE k.p > t.q
 QUALIFY row_number() OVER (PARTITION BY k.lang, k.source ORDER BY value DESC, k.term) <= $1)"""
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


@contextmanager
def _database() -> Iterator[duckdb.DuckDBPyConnection]:
    """An empty database in memory, for one task; what it spills goes to the task's own folder and with the task."""
    folder = tempfile.mkdtemp(prefix="graphloom-")
    db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": folder, "preserve_insertion_order": False})
    try:
        yield db
    finally:
        db.close()
        shutil.rmtree(folder, ignore_errors=True)


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _counted(docs: DataFrame, shards: int) -> DataFrame:
    """(shard, counts): the tasks' counts by (lang, source, term), an Arrow stream for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _database() as db:

            def pack(parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
                counts = pa.concat_tables(parts)
                rows = db.sql(f"SELECT hash(lang, term) % {shards} AS shard, * FROM counts ORDER BY shard, lang, source, term").to_arrow_table()
                shard = rows["shard"].combine_chunks().to_numpy()
                cuts = [0, *((shard[1:] != shard[:-1]).nonzero()[0] + 1).tolist(), len(shard)] if len(shard) else [0]
                for a, b in zip(cuts, cuts[1:]):
                    yield pa.record_batch([pa.array([int(shard[a])], pa.int64()), pa.array([_packed(rows.slice(a, b - a).drop_columns("shard"))], pa.binary())], ["shard", "counts"])

            parts, held = [], 0
            for b in batches:
                batch = pa.table({"r": pa.array(range(b.num_rows), pa.int64()), "lang": b.column(0), "source": b.column(1), "text": pc.ascii_lower(b.column(2))})  # noqa: F841
                parts.append(db.sql(_OF_BATCH).to_arrow_table())
                held += parts[-1].num_rows
                if held > GATHERED:
                    counts = pa.concat_tables(parts)  # noqa: F841
                    parts = [db.sql(_ADDED).to_arrow_table()]
                    held = parts[0].num_rows
                    if held > GATHERED // 2:
                        yield from pack(parts)
                        parts, held = [], 0
            if held:
                yield from pack(parts)

    bounded(docs.sparkSession)
    return docs.mapInArrow(run, "shard long, counts binary")


def _kept(counted: DataFrame, least: int) -> DataFrame:
    """(lang, source, term, n, first) of the terms in at least ``least`` documents of their language; first: of one source of each term."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _database() as db:
            db.execute("CREATE TABLE counts (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
            for batch in batches:
                for blob in batch["counts"]:
                    come = pa.ipc.open_stream(blob.as_buffer()).read_all()  # noqa: F841
                    db.execute("INSERT INTO counts SELECT lang, source, term, n, docs FROM come")
            yield from _answers(db.sql(_KEPT, params=[least]))

    return counted.groupBy("shard").applyInArrow(run, "lang string, source string, term string, n long, first boolean")


def _answers(result: duckdb.DuckDBPyRelation) -> Iterator[pa.RecordBatch]:
    for batch in result.to_arrow_reader(50_000):
        if batch.num_rows:
            yield batch


def _summed(rows: DataFrame, shards: int, most: int) -> DataFrame:
    """Partial results of the shards: (part, lang, source, item, value, p, terms)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _database() as db:
            db.execute("CREATE TABLE rows (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, n_group DECIMAL(38, 0), n_lang DECIMAL(38, 0), v BIGINT)")
            for batch in batches:
                come = pa.Table.from_batches([batch])  # noqa: F841
                db.execute("INSERT INTO rows SELECT lang, source, term, n, n_group, n_lang, v FROM come")
            db.execute(_SHARES)
            yield from _answers(db.sql(_PARTS, params=[most]))

    return rows.repartition(shards, "lang", "term").mapInArrow(run, "part string, lang string, source string, item string, value decimal(38,0), p long, terms long")


def divergence(docs: DataFrame, least: int = 3, most: int = 200, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): how the words of each source of a language differ from other sources and from the language.

    Terms are runs of letters of ASCII, lower-cased, and of characters beyond
    ASCII. A language keeps the V terms in at least ``least`` of its documents
    (rows). A source with N occurrences of them gives a term that it has
    ``count`` times the share p = 1 + floor(1e9 (count + 1) / (N + V)). Between
    two shares lies f = floor((p - q)^2 / q).

    * part "pair": every other source of the language, f summed over its kept terms;
    * part "term": the kept terms with a larger share here than in the language
      as a whole, by f, of rank ``most`` at most.

    Null texts, languages and sources count as "". Sources without terms and
    languages that keep none have pairs of the value that follows (0 if V = 0).
    Ties go to the item that is smaller in UTF-8. Repeated rows count each;
    other columns are not read; an empty table gives an empty table. The number
    of shards is that of spark.sql.shuffle.partitions.
    """
    spark, shards = docs.sparkSession, shuffle_partitions(docs.sparkSession)
    text = lambda c: F.coalesce(F.make_valid_utf8(F.col(f"`{c}`")), F.lit(""))
    read = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    kept = save(_kept(_counted(read, shards), least), "kept-terms")
    sums = kept.groupBy("lang", "source").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n_group"), F.sum(F.col("first").cast("long")).alias("firsts"))
    groups = read.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").na.fill(0, ["firsts"]).withColumn("n_group", F.coalesce("n_group", F.lit(0).cast("decimal(38,0)")))
    of_lang = Window.partitionBy("lang")
    groups = save(groups.select("lang", "source", "n_group", F.sum("n_group").over(of_lang).cast("decimal(38,0)").alias("n_lang"), F.sum("firsts").over(of_lang).alias("v")), "groups")
    parts = save(_summed(kept.drop("first").join(groups, ["lang", "source"]).select("lang", "source", "term", "n", "n_group", "n_lang", "v"), shards, most), "partial")

    f = lambda p, q: f"cast(({p} - {q}) * ({p} - {q}) div {q} as decimal(38,0))"
    zero = F.expr(f"case when v > 0 then 1 + {SCALE} div (n_group + v) end")
    a = groups.select("lang", "source", "v", zero.alias("p0"))
    pairs = a.join(a.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0")), "lang").where("source <> item")
    share = parts.where("part = 'share'").groupBy("lang", "source", "p").agg(F.sum("terms").alias("terms"))
    mine = pairs.join(share, ["lang", "source"]).select("lang", "source", "item", F.expr(f"({f('p', 'q0')} - {f('p0', 'q0')}) * terms").alias("value"))
    other = pairs.join(share.withColumnRenamed("source", "item"), ["lang", "item"]).select("lang", "source", "item", F.expr(f"({f('p0', 'p')} - {f('p0', 'q0')}) * terms").alias("value"))
    none = pairs.select("lang", "source", "item", F.expr(f"coalesce({f('p0', 'q0')} * v, 0)").alias("value"))
    both = parts.where("part = 'pair'").select("lang", "source", "item", "value")
    whole = lambda df: df.withColumn("value", F.col("value").cast("decimal(38,0)"))
    pair = whole(none).unionByName(whole(mine)).unionByName(whole(other)).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    term = parts.where("part = 'term'").select("lang", "source", "item", "value", F.row_number().over(ranked).alias("rank")).where(F.col("rank") <= most).withColumn("part", F.lit("term"))
    out = pair.withColumn("rank", F.row_number().over(ranked)).unionByName(term)
    return out.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank")
