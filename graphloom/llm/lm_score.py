"""Log-probabilities of texts under an n-gram model of the corpus, by a weighted backoff automaton.

Every n-gram of the rows that are learned from counts; none is pruned, so the
model grows with the corpus, and no task holds it whole:

1. A block (an Arrow batch of rows) is turned into word numbers once and saved;
   words are known by 64-bit hashes, n-grams by hashes of those.
2. Each block sends its distinct n-grams with their counts, packed by shard of
   the hash. A shard adds them up and answers each block with the totals of
   its own n-grams, in the order sent. A common n-gram is one entry a block.
3. A block with its answers is its part of the automaton. A known history is a
   state; the arc of word w at history h, seen c(h, w) times, weighs
   log10 P(w | h), and the failure arc leads to the history without its first
   word and weighs log10 e(h):
     P(w | h) = (1 - e(h)) c(h, w) / c(h) + e(h) P(w | shorter h),
     e(h) = ESCAPE c(h)^(GROWTH - 1), the share of words that are new after h
   when distinct followers grow as a power of c(h). At the root, which has an
   arc for every word, P(w) = (c(w) + 1) / (N + V + 1), one part being left for
   unknown words. For each history the probabilities add up to 1.
4. One traversal from left to right, all texts of the block side by side,
   carries a state for each text and adds up the weights of the arcs taken.

Blocks and answers are written to the shared folder, so a lost executor costs
the tasks that it held. Two words of one hash would count as one: one pair is
expected among some 6e9 distinct words.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.batches import as_bytes, bounded
from graphloom.plans import save, shuffle_partitions

#: Of the share of mass that a history leaves to shorter ones.
ESCAPE, GROWTH = 0.8, 0.9
#: The hash of the history before the first word.
START = np.uint64(0x9E3779B97F4A7C15)
_ONE, _TWO, _S = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(31)


def held_out(id_col: str, folds: int = 7, fold: int = 2) -> F.Column:
    """True where the CRC-32 of the id as text leaves ``fold`` when divided by ``folds``, and for null ids."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % folds == fold, F.lit(True))


def _packed(x: np.ndarray) -> bytes:
    """Numbers byte by byte, all first bytes before all second ones, compressed."""
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _numbered(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, and the place of each code among them; half the memory of np.unique."""
    by_code = np.argsort(codes)
    codes = codes[by_code]
    new = np.ones(len(codes), bool)
    np.not_equal(codes[1:], codes[:-1], out=new[1:])
    inverse = np.empty(len(codes), np.int32)
    inverse[by_code] = np.cumsum(new, dtype=np.int32) - 1
    return codes[new], inverse


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a ^ (a >> _S)) * _ONE + (b ^ (b >> _S)) * _TWO
    h = (h ^ (h >> np.uint64(29))) * _ONE
    return h ^ (h >> _S)


class _Block:
    """Texts of a block as word numbers; ``hashes`` of its words ascend, and a text ends with the empty word.

    Numbers of words, n-grams and places have four bytes, as a block has fewer
    than 2^31 tokens: two blocks at a time share an executor's memory.
    """

    def __init__(self, hashes: np.ndarray, lengths: np.ndarray, seq: np.ndarray, learned: np.ndarray) -> None:
        self.hashes, self.lengths, self.seq, self.learned = hashes, lengths, seq.view(np.int32), np.repeat(learned, lengths)
        self.starts = np.cumsum(lengths) - lengths

    def _counts(self, at: np.ndarray, n: int) -> np.ndarray:
        """How often each n-gram ends at a place of a learned text."""
        return np.bincount(at[self.learned & (at >= 0)], minlength=n).astype(np.uint32)

    def ngrams(self, order: int) -> list[dict[str, np.ndarray]]:
        """For n from 1 to ``order``: keys of the distinct n-grams, their counts in learned texts, history and word, and the n-gram that ends at each place (or -1).

        The history is a number of an (n-1)-gram; of a bigram, a word or, where
        the text begins, the number after the last word.
        """
        n_words = len(self.hashes)
        out = [{"keys": self.hashes, "counts": self._counts(self.seq, n_words), "at": self.seq, "word": np.arange(n_words, dtype=np.int32), "history": np.full(n_words, -1, np.int32)}]
        for n in range(2, order + 1):
            before = np.empty_like(self.seq)
            before[1:] = out[-1]["at"][:-1]
            before[self.starts] = n_words if n == 2 else -1
            known = before >= 0
            code = before[known].astype(np.int64)
            del before
            code *= n_words
            code += self.seq[known]
            code, inverse = _numbered(code)
            at = np.full(len(self.seq), -1, np.int32)
            at[known] = inverse
            del known, inverse
            history = (code // n_words).astype(np.int32)
            code -= history.astype(np.int64) * n_words
            word = code.astype(np.int32)
            del code
            of = np.append(self.hashes, START) if n == 2 else out[-1]["keys"]
            out.append({"keys": _mixed(of[history], self.hashes[word]), "counts": self._counts(at, len(word)), "at": at, "word": word, "history": history})
        return out


def _blocks(docs: DataFrame, id_col: str, text_col: str, folds: int, fold: int) -> DataFrame:
    """A row a block: block, ids, held_out, lengths, seq and hashes; seq and hashes are packed."""
    read = docs.select(F.col(f"`{id_col}`").alias("id"), held_out(id_col, folds, fold).alias("held_out"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for i, batch in enumerate(batches):
            number = defaultdict(itertools.count().__next__)
            parts = []
            for text in as_bytes(batch["text"]):
                words = text.lower().split()  # ASCII letters, ASCII white space
                words.append(b"")
                parts.append(np.fromiter(map(number.__getitem__, words), np.uint32, len(words)))
            if not parts:
                continue
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))
            order = np.argsort(hashes)
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            ids, held = batch["id"], batch["held_out"]
            offsets = pa.array([0, batch.num_rows], pa.int32())
            columns = [pa.array([f"{task}-{i}"]), pa.ListArray.from_arrays(offsets, ids), pa.ListArray.from_arrays(offsets, held), pa.array([[len(p) for p in parts]], pa.list_(pa.int64()))]
            columns += [pa.array([_packed(rank[np.concatenate(parts)])], pa.binary()), pa.array([_packed(np.diff(hashes[order], prepend=np.uint64(0)))], pa.binary())]
            yield pa.record_batch(columns, ["block", "ids", "held_out", "lengths", "seq", "hashes"])

    bounded(docs.sparkSession)
    return read.mapInArrow(run, f"block string, ids array<{read.schema['id'].dataType.simpleString()}>, held_out array<boolean>, lengths array<long>, seq binary, hashes binary")


def _block_of(lengths: list[int], seq: bytes, hashes: bytes, held: list[bool]) -> _Block:
    return _Block(np.cumsum(_unpacked(hashes, np.uint64), dtype=np.uint64), np.array(lengths, np.int64), _unpacked(seq, np.uint32), ~np.array(held, bool))


def _cuts(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's range begins in ascending keys, and the end."""
    step = 2**64 / shards
    return np.searchsorted(keys, np.array([min(int(i * step), 2**64 - 1) for i in range(shards)] , np.uint64)).tolist() + [len(keys)]


def _sent(blocks: DataFrame, order: int, shards: int) -> DataFrame:
    """(shard, block, keys, counts): the distinct n-grams of each block by shard, an entry for each n, ascending by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, lengths, seq, hashes, held in zip(*(batch[c].to_pylist() for c in ("block", "lengths", "seq", "hashes", "held_out")), strict=True):
                sides = []
                for g in _block_of(lengths, seq, hashes, held).ngrams(order):
                    by_key = np.argsort(g["keys"], kind="stable")
                    keys = g["keys"][by_key]
                    sides.append((keys, g["counts"][by_key], _cuts(keys, shards)))
                cells = [[(k[c[s] : c[s + 1]], n[c[s] : c[s + 1]]) for k, n, c in sides] for s in range(shards)]
                some = [s for s, cell in enumerate(cells) if any(len(k) for k, _ in cell)]
                keys = [[_packed(np.diff(k, prepend=np.uint64(0))) for k, _ in cells[s]] for s in some]
                yield pa.record_batch([pa.array(some, pa.int32()), pa.array([name] * len(some)), pa.array(keys, pa.list_(pa.binary())), pa.array([[_packed(n) for _, n in cells[s]] for s in some], pa.list_(pa.binary()))], ["shard", "block", "keys", "counts"])

    return blocks.select("block", "lengths", "seq", "hashes", "held_out").mapInArrow(run, "shard int, block string, keys array<binary>, counts array<binary>")


def _answered(sent: DataFrame, order: int) -> DataFrame:
    """(shard, block, totals, tokens, types): what the shard has counted for each n-gram that the block sent; on one row of a shard, its learned tokens and distinct words."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, keys, counts = [], [[] for _ in range(order)], [[] for _ in range(order)]
        for batch in batches:
            names += batch["block"].to_pylist()
            for mine, column, kind in ((keys, "keys", np.uint64), (counts, "counts", np.uint32)):
                for row in batch[column].to_pylist():
                    for n, data in enumerate(row):
                        mine[n].append(np.cumsum(_unpacked(data, kind), dtype=np.uint64) if kind is np.uint64 else _unpacked(data, kind))
        totals, tokens, types = [], 0, 0
        for n in range(order):
            ends = np.cumsum([len(k) for k in keys[0]])
            unique, inverse = _numbered(np.concatenate(keys.pop(0)))
            total = np.zeros(len(unique), np.int64)
            del unique
            for mine, stop in zip(counts.pop(0), ends.tolist(), strict=True):
                np.add.at(total, inverse[stop - len(mine) : stop], mine)
            if n == 0:
                tokens, types = int(total.sum()), int((total > 0).sum())
            totals.append([_packed(total[x]) for x in np.split(inverse, ends[:-1])])
        shard = key[0].as_py()
        for i, name in enumerate(names):
            yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([name]), pa.array([[t[i] for t in totals]], pa.list_(pa.binary())), pa.array([tokens if not i else 0], pa.int64()), pa.array([types if not i else 0], pa.int64())], ["shard", "block", "totals", "tokens", "types"])

    return sent.groupBy("shard").applyInArrow(run, "shard int, block string, totals array<binary>, tokens long, types long")


class Automaton:
    """The states and arcs that a block needs. codes: state * words + word, ascending; the last state is the root, which has an arc for every word."""

    def __init__(self, grams: list[dict[str, np.ndarray]], totals: list[np.ndarray], tokens: int, types: int) -> None:
        """``totals``: learned counts of the n-grams, in their order; ``tokens`` and ``types`` of the whole corpus."""
        words, order = len(grams[0]["word"]), len(grams)
        self.words, c = words, totals[0]
        self.root_weight = np.log10((c + 1) / (tokens + types + 1))
        # states of histories of length 1 (words and the start), 2, ... and the root; a history has been seen as often as its n-gram, the start once a text
        begin, seen = [0, 0], []
        end = int(c[grams[0]["end"]]) if "end" in grams[0] else 0
        for n in range(1, order):
            seen.append(np.append(c, end) if n == 1 else totals[n - 1])
            begin.append(begin[-1] + len(seen[-1]))
        self.root = begin[-1]
        count = np.concatenate([*seen, [1]]) if seen else np.array([1])
        escape = np.minimum(1.0, ESCAPE * np.maximum(count, 1) ** (GROWTH - 1.0))
        kind = np.int32 if self.root < 1 << 31 else np.int64
        self.fail_weight, self.fail = np.log10(escape), np.full(self.root + 1, self.root, kind)
        state_of = [np.where((c > 0) & (np.arange(words) != grams[0].get("end", -1)), np.arange(words), self.root).astype(kind)] if order > 1 else [np.full(words, self.root, kind)]
        codes, weights, targets, lower = [], [], [], (c + 1) / (tokens + types + 1)
        for n in range(2, order + 1):
            g, total = grams[n - 1], totals[n - 1]
            history, word, size = g["history"], g["word"], len(grams[n - 2]["word"]) + (n == 2)
            suffix = np.zeros(len(total), np.int32)
            some = g["at"] >= 0
            suffix[g["at"][some]] = grams[n - 2]["at"][some]  # at some place where the n-gram ends
            del some
            e = escape[begin[n - 1] : begin[n - 1] + size][history]
            p = (1 - e) * total
            p /= np.maximum(seen[n - 2], 1)[history]
            e *= lower[suffix]
            p += e
            del e
            known = total > 0
            if n < order:  # the n-gram is a state of its own, which fails to its suffix
                own = np.arange(begin[n], begin[n] + len(total), dtype=kind)
                self.fail[own] = state_of[-1][suffix]
                state_of.append(np.where(known, own, state_of[-1][suffix]))
                target = state_of[-1]
            else:
                target = state_of[-1][suffix]
            targets.append(target[known])
            del suffix, target
            codes.append((begin[n - 1] + history[known].astype(np.int64)) * words + word[known])
            weights.append(np.log10(p[known]))
            lower = p
        del lower, seen, count, escape
        self.codes = np.concatenate([*codes, self.root * words + np.arange(words)])
        del codes
        self.weights = np.concatenate([*weights, self.root_weight])
        del weights
        self.targets = np.concatenate([*targets, state_of[0]])
        self.start = words if order > 1 and end else self.root  # where nothing is learned no text has begun

    def score(self, seq: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """One traversal of all texts, which lie one after another in ``seq``: log10 probability of each."""
        by_length = np.argsort(-lengths, kind="stable")
        starts, sizes = (np.cumsum(lengths) - lengths)[by_length], lengths[by_length]
        state, sums = np.full(len(lengths), self.start), np.zeros(len(lengths))
        live = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), side="left")  # texts longer than t
        for t, n in enumerate(live.tolist()):
            word, todo = seq[starts[:n] + t], np.arange(n)
            while len(todo):
                here = state[todo]
                code = here.astype(np.int64) * self.words + word[todo]
                arc = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
                hit = self.codes[arc] == code
                took = todo[hit]
                sums[took] += self.weights[arc[hit]]
                state[took] = self.targets[arc[hit]]
                todo, here = todo[~hit], here[~hit]
                sums[todo] += self.fail_weight[here]
                state[todo] = self.fail[here]
        out = np.empty(len(lengths))
        out[by_length] = sums
        return out


def _scored(block: _Block, order: int, totals: list[np.ndarray], tokens: int, types: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(known words, base score, score) of the texts of a block; ``totals`` ascend by key and are used up."""
    grams, mine = block.ngrams(order), []
    for g in grams:
        total = totals.pop(0)
        back = np.empty(len(total), np.int64)
        back[np.argsort(g.pop("keys"), kind="stable")] = total
        mine.append(back)
        del g["counts"]
    grams[0]["end"] = int(block.seq[block.lengths[0] - 1])
    machine = Automaton(grams, mine, tokens, types)
    del grams
    known = np.add.reduceat((mine[0] > 0)[block.seq].astype(np.int64), block.starts)
    return known, np.add.reduceat(machine.root_weight[block.seq], block.starts), machine.score(block.seq, block.lengths)


def lm_score(docs: DataFrame, order: int = 2, folds: int = 7, fold: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Tokens are runs of characters other than ASCII white space, A-Z lower-cased,
    and one end. The model learns from the rows that are not held out (see
    ``held_out``) and scores all. ``score`` is the log10 probability of the
    text, its end included; ``base_score`` that of an add-one unigram model.

    Null texts count as empty: their one token is the end. Rows that repeat
    count and are scored each; rows with a null id are held out. Where nothing
    is learned, every token has probability 1. Other columns are not read; an
    empty table gives an empty table. A task holds a block (16 MB of texts, or
    one longer text) or the n-grams of one shard, whose number is that of
    spark.sql.shuffle.partitions.
    """
    blocks = save(_blocks(docs, id_col, text_col, folds, fold), "blocks")
    answers = save(_answered(_sent(blocks, order, shuffle_partitions(docs.sparkSession)), order), "answers")
    tokens, types = (x or 0 for x in answers.agg(F.sum("tokens"), F.sum("types")).first())
    id_type = blocks.schema["ids"].dataType.elementType.simpleString()

    def run(mine: pa.Table, told: pa.Table) -> pa.Table:
        row = mine.to_pylist()[0]
        told = told.sort_by("shard")["totals"].to_pylist()
        totals = [np.concatenate([_unpacked(t[n], np.int64) for t in told]) for n in range(order)]
        known, base, score = _scored(_block_of(row["lengths"], row["seq"], row["hashes"], row["held_out"]), order, totals, tokens, types)
        ids = mine["ids"].combine_chunks().flatten()
        columns = [ids, pa.array(row["held_out"], pa.bool_()), pa.array(row["lengths"], pa.int64()), pa.array(known), pa.array(np.full(len(known), tokens)), pa.array(base), pa.array(score)]
        return pa.table(columns, ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    both = blocks.groupBy("block").cogroup(answers.select("block", "shard", "totals").groupBy("block"))
    return both.applyInArrow(run, schema).withColumnRenamed("id", id_col)
