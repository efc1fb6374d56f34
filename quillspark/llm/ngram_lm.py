"""Language-model scoring with a sharded Elias-Fano n-gram trie (operator 9).

The model is a bigram trie over reversed pairs: a word and below it the words before it. Every pair (word, word before)
of every text is sent to the shard of its word; the shard counts the training pairs, lays them out as a compact trie and
scores all its pairs against it, so neither the trie nor the corpus ever goes through the driver or to every task. A
shard's levels are monotone sequences in Elias-Fano code, in a memory-mapped file: hashes of words, hashes of words
before, where each word's children begin, and the children, each as (word, word before) numbers, so that a successor
search looks among its own word's children only. The smoothed weights lie beside the children, quantised to 256 values.

Smoothing is a Dirichlet prior: p(w|u) = (c(u,w) + M p(w)) / (c(u) + M) with p(w) = (c(w) + 1/2) / (N + (V + 1) / 2). Its
logarithm falls into a part that the shard of w knows and a part of c(u) alone, which the shard of u adds when it meets
u as a word: one pass over one shuffle gives whole probabilities.

Pairs travel as counts per text. Words that are much of the corpus (and the end of texts) are split over several shards
by the word before; a pair that comes up in very many texts is split over shards of its own by text. Held-out texts count
for the split, and split words' and pairs' training counts are known to their shards from a pass before.

Words are named by 64-bit hashes. Texts whose crc32(doc_id as text) mod 5 is 1 are held out; the rest is learnt from.

Defined results: a null text counts as empty (its end is its one token); a null doc_id counts as empty text for the
crc32, so it is learnt from. Rows that repeat are learnt from and scored one by one. Without training texts all counts
are 0. Other columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import math
import mmap
import pickle
import tempfile
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_TABLE, documents, parts, saved, text_bytes
from .elias_fano import EliasFano

FOLDS, HELD_OUT = 5, 1
#: M of the prior, and values that a shard's weights are quantised to.
PRIOR, CODES = 300.0, 256
#: Training pairs that one shard holds on average; a task's memory is about a hundred bytes for each.
SHARD = 3_000_000
#: Pairs that a task gathers before it sends them on.
GATHER = 3_000_000
#: Names of the end and the start of a text; no word hashes to a byte of white space.
END, START = b"\n", b" "


def word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = word_hash(word)
        return h


def _rows(docs: DataFrame) -> DataFrame:
    """``rid`` (a number for each row of this scan), ``doc_id, held_out, text``."""
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT
    return docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), text_bytes().alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n, total``: how often the training texts and all texts have each token, the end of texts included."""
    def run(batches):
        learnt, other = Counter(), Counter()

        def out():
            words = list(learnt.keys() | other.keys())
            n = [learnt[w] for w in words]
            columns = [[word_hash(w) for w in words], n, [k + other[w] for k, w in zip(n, words)]]
            learnt.clear()
            other.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["word", "n", "total"])

        for batch in batches:
            for text, held in zip(batch.column("text").to_pylist(), batch.column("held_out").to_pylist()):
                seen = other if held else learnt
                seen.update(text.translate(LOWER_TABLE).split())
                seen[END] += 1
                if len(learnt) + len(other) > GATHER // 3:
                    yield out()
        yield out()

    counted = _rows(docs).select("text", "held_out").mapInArrow(run, "word long, n long, total long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


@dataclass(frozen=True)
class Plan:
    """Sizes of the training text and where pairs go: to ``shards`` shards by word, split words to their own."""

    tokens: int  # N
    words: int  # V
    texts: int  # training texts
    shards: int
    split: dict  # word -> (count, first shard, number of shards)
    hot: dict  # word -> {word before -> (count, first shard, number of shards)}

    @property
    def log_unit(self) -> float:
        """log10 of N + (V + 1) / 2."""
        return math.log10(self.tokens + 0.5 * (self.words + 1))


def hot_pairs(docs: DataFrame, words: list[int], shard: int = SHARD) -> DataFrame:
    """``word, before, n, texts`` of the pairs of these words (and the start of texts) that over half a shard's texts hold:
    training count, and texts, the held-out ones included."""
    known = np.array(sorted({*words, word_hash(START)}), np.int64)

    def run(batches):
        for word, before, text, _, _, held in blocks(batches):
            at, to = np.searchsorted(known, word) % len(known), np.searchsorted(known, before) % len(known)
            rows = np.nonzero((known[at] == word) & (known[to] == before))[0]
            pair, text = at[rows] * len(known) + to[rows], text[rows]
            codes, which = np.unique(pair, return_inverse=True)
            n = np.bincount(which[~held[text]], minlength=len(codes))
            order = np.lexsort((text, which))
            which, text = which[order], text[order]
            first = np.ones(len(which), bool)
            first[1:] = (which[1:] != which[:-1]) | (text[1:] != text[:-1])
            texts = np.bincount(which[first], minlength=len(codes))
            columns = [known[codes // len(known)], known[codes % len(known)], n, texts]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["word", "before", "n", "texts"])

    found = _rows(docs).mapInArrow(run, "word long, before long, n long, texts long")
    return found.groupBy("word", "before").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts")).where(F.col("texts") * 2 > shard)


def plan_shards(docs: DataFrame, counts: DataFrame, shard: int = SHARD) -> Plan:
    """Words with more than half a shard's pairs are split, and of these the pairs that are in more texts than half a
    shard's pairs; there are at most 2 / ``shard`` of all tokens of each."""
    tokens, words, total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("total"), F.lit(0))).first()
    shards = total // shard + 1
    large = {r.word: (r.n, r.total) for r in counts.where(F.col("total") * 2 > shard).collect()}
    texts = (counts.where(F.col("word") == word_hash(END)).agg(F.sum("n")).first()[0]) or 0
    split, hot, at = {}, {}, shards
    for word in sorted(large):
        n = 2 * large[word][1] // shard + 1
        split[word] = (large[word][0], at, n)
        at += n
    if split:
        for r in sorted(hot_pairs(docs, list(split), shard).collect()):
            n = 2 * r.texts // shard + 1
            hot.setdefault(r.word, {})[r.before] = (r.n, at, n)
            at += n
    return Plan(tokens, words, texts, shards, split, hot)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shard_of(plan: Plan, word: np.ndarray, before: np.ndarray, rid: np.ndarray) -> np.ndarray:
    out = (_mix(word) % np.uint64(plan.shards)).astype(np.int64)
    for hot, (_, first, n) in plan.split.items():
        if len(rows := np.nonzero(word == hot)[0]):
            out[rows] = first + (_mix(before[rows]) % np.uint64(n)).astype(np.int64)
            for b, (_, start, k) in plan.hot.get(hot, {}).items():
                some = rows[before[rows] == b]
                out[some] = start + (_mix(rid[some]) % np.uint64(k)).astype(np.int64)
    return out


def _smallest(x: np.ndarray) -> np.ndarray:
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32)


def _packed(word, before, text, rid, doc_id, held) -> bytes:
    """The pairs of one shard, sorted by word, how often each text has them, and the texts, as compressed arrays."""
    import zstandard

    order = np.lexsort((before, text, word))
    word, before, text = word[order], before[order], text[order]
    first = np.ones(len(order), bool)
    first[1:] = (word[1:] != word[:-1]) | (text[1:] != text[:-1]) | (before[1:] != before[:-1])
    each = np.diff(np.append(np.nonzero(first)[0], len(order)))
    words, runs = np.unique(word[first], return_counts=True)
    befores, before_at = np.unique(before[first], return_inverse=True)
    texts, text_at = np.unique(text[first], return_inverse=True)
    known = [d is not None for d in (doc_id[i] for i in texts)]
    return zstandard.compress(pickle.dumps((
        words, _smallest(runs), befores, _smallest(before_at), _smallest(text_at), np.diff(rid[texts], prepend=0),
        np.diff(np.array([doc_id[i] or 0 for i in texts], np.int64), prepend=0), np.array(known, bool), held[texts], _smallest(each),
    ), protocol=5), 3)


def blocks(batches):
    """Of the texts of ``batches``, gathered to GATHER pairs: every pair's word, word before and text (its place), and the
    texts' ``rid, doc_id, held_out``."""
    hashes, start, end = WordHashes(), word_hash(START), word_hash(END)
    words, ends, rid, doc_id, held = [], [], [], [], []

    def block():
        lengths = np.array(ends, np.int64) + 1  # a pair for each word and the end
        text = np.repeat(np.arange(len(ends)), lengths)
        flat = np.concatenate(words) if words else np.zeros(0, np.int64)
        last = np.cumsum(lengths) - 1
        first = last - lengths + 1
        word = np.full(len(text), end)
        word[np.delete(np.arange(len(text)), last)] = flat
        before = np.full(len(text), start)
        before[np.delete(np.arange(len(text)), first)] = flat
        out = word, before, text, np.array(rid, np.int64), list(doc_id), np.array(held, bool)
        for x in (words, ends, rid, doc_id, held):
            x.clear()
        return out

    size = 0
    for batch in batches:
        for part in parts(batch):
            for r, d, h, t in zip(*(part.column(c).to_pylist() for c in ("rid", "doc_id", "held_out", "text"))):
                w = t.translate(LOWER_TABLE).split()
                words.append(np.fromiter(map(hashes.__getitem__, w), np.int64, len(w)))
                for column, x in zip((ends, rid, doc_id, held), (len(w), r, d, h)):
                    column.append(x)
                size += len(w) + 1
                if size >= GATHER:
                    yield block()
                    size = 0
            if len(hashes) > 500_000:
                hashes.clear()
    if ends:
        yield block()


def pairs(docs: DataFrame, plan: Plan) -> DataFrame:
    """``shard, block, pairs binary``: all pairs of all texts, gathered by block (the texts that a task sends at once, named
    by the first one's ``rid``) and shard."""
    def run(batches):
        for word, before, text, rid, doc_id, held in blocks(batches):
            shard = shard_of(plan, word, before, rid[text])
            order = np.argsort(shard, kind="stable")
            shards, begin = np.unique(shard[order], return_index=True)
            for s, i, j in zip(shards.tolist(), begin.tolist(), [*begin[1:].tolist(), len(order)]):
                rows = order[i:j]
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([int(rid[0])], pa.int64()), pa.array([_packed(word[rows], before[rows], text[rows], rid, doc_id, held)], pa.binary())], ["shard", "block", "pairs"])

    return _rows(docs).mapInArrow(run, "shard long, block long, pairs binary")


class Trie:
    """The levels of one shard. ``find`` gives the log10 weight of pairs, nan for pairs it doesn't hold."""

    def __init__(self, words: EliasFano, befores: EliasFano, begins: EliasFano, children: EliasFano, codes: np.ndarray, book: np.ndarray) -> None:
        self.words, self.befores, self.begins, self.children, self.codes, self.book = words, befores, begins, children, codes, book

    @classmethod
    def build(cls, word: np.ndarray, before: np.ndarray, weight: np.ndarray) -> Trie:
        """From distinct pairs sorted by (word, word before) and their log10 weights (hashes as uint64)."""
        words, at = np.unique(word, return_inverse=True)
        befores, to = np.unique(before, return_inverse=True)
        begins = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(words)))]).astype(np.uint64)
        edges = np.linspace(weight.min(), weight.max(), CODES + 1)[1:-1] if len(weight) else np.zeros(0)
        codes = np.searchsorted(edges, weight).astype(np.uint8)
        book = np.bincount(codes, weight, CODES) / np.maximum(np.bincount(codes, minlength=CODES), 1)
        width = max(len(befores), 1)
        children = at.astype(np.uint64) * np.uint64(width) + to.astype(np.uint64)
        return cls(EliasFano.build(words, 1 << 64), EliasFano.build(befores, 1 << 64), EliasFano.build(begins, len(at) + 1),
                   EliasFano.build(children, max(len(words), 1) * width), codes, book)

    def mapped(self) -> Trie:
        """The same trie over a memory-mapped file, which goes when the trie goes."""
        arrays = [*(p for level in (self.words, self.befores, self.begins, self.children) for p in level.parts()), self.codes, self.book]
        with tempfile.TemporaryFile() as f:
            places = []
            for a in arrays:
                places.append(f.tell())
                f.write(a.tobytes() + bytes(-a.nbytes % 8))
            f.write(bytes(8))
            f.flush()
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        got = [np.frombuffer(data, a.dtype, a.size, at) for a, at in zip(arrays, places)]
        return Trie(*(EliasFano.from_parts(got[i : i + 4]) for i in (0, 4, 8, 12)), *got[16:])

    def children_of(self, numbers: np.ndarray) -> np.ndarray:
        """How many different words stand before each word."""
        return (self.begins.access(numbers + 1) - self.begins.access(numbers)).astype(np.int64)

    def find(self, words: np.ndarray, befores: np.ndarray, block: int = 1 << 18) -> np.ndarray:
        out = np.full(len(words), np.nan)
        width = np.uint64(max(self.befores.length, 1))
        for i in range(0, len(words), block):
            number, to = self.words.find(words[i : i + block]), self.befores.find(befores[i : i + block])
            rows = np.nonzero((number >= 0) & (to >= 0))[0]
            at = self.children.find(number[rows].astype(np.uint64) * width + to[rows].astype(np.uint64))
            out[i + rows[at >= 0]] = self.book[self.codes[at[at >= 0]]]
        return out


def _unsigned(x: np.ndarray) -> np.ndarray:
    return x.view(np.uint64) ^ np.uint64(1 << 63)


def _joined(tables: list[np.ndarray], places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All distinct hashes of the chunks' tables, sorted, and every row's place among them."""
    known = np.unique(np.concatenate(tables))
    return known, np.concatenate([np.searchsorted(known, t).astype(np.int32)[p] for t, p in zip(tables, places)])


def score_shard(chunks: list[bytes], plan: Plan) -> list[bytes]:
    """For each chunk the sums of its texts over its pairs: packed ``rid, doc_id, known, held_out, n, n_known, base, score``."""
    import zstandard

    got = [pickle.loads(zstandard.decompress(c)) for c in chunks]
    words, at = _joined([_unsigned(g[0]) for g in got], [np.repeat(np.arange(len(g[0])), g[1]) for g in got])
    befores, to = _joined([_unsigned(g[2]) for g in got], [g[3] for g in got])
    offsets = np.cumsum([0, *(len(g[5]) for g in got)])
    text = np.concatenate([g[4].astype(np.int32) + int(o) for g, o in zip(got, offsets)])
    rid, doc_id = np.concatenate([np.cumsum(g[5]) for g in got]), np.concatenate([np.cumsum(g[6]) for g in got])
    known_id, held, each = (np.concatenate([g[k] for g in got]) for k in (7, 8, 9))
    del got, chunks
    learnt = ~held[text]

    total = np.bincount(at[learnt], each[learnt], len(words)).astype(np.int64)
    for hot, (n, _, _) in plan.split.items():
        if (i := np.searchsorted(words, w := np.uint64(hot + (1 << 63)))) < len(words) and words[i] == w:
            total[i] = n
    prior = PRIOR * (total + 0.5) / 10**plan.log_unit
    code, pair = np.unique(at.astype(np.int64) * len(befores) + to, return_inverse=True)
    pair = pair.astype(np.int32)
    pair_word, pair_before = code // len(befores), code % len(befores)
    count = np.bincount(pair[learnt], each[learnt], len(code)).astype(np.int64)
    for hot, by_before in plan.hot.items():
        if (i := np.searchsorted(words, w := np.uint64(hot + (1 << 63)))) < len(words) and words[i] == w:
            for b, (n, _, _) in by_before.items():
                if (j := np.searchsorted(befores, v := np.uint64(b + (1 << 63)))) < len(befores) and befores[j] == v:
                    if (k := np.searchsorted(code, c := int(i) * len(befores) + int(j))) < len(code) and code[k] == c:
                        count[k] = n
    seen = count > 0
    trie = Trie.build(words[pair_word[seen]], befores[pair_before[seen]], np.log10(count[seen] + prior[pair_word[seen]])).mapped()
    log_p = trie.find(words[pair_word], befores[pair_before])
    missed = np.isnan(log_p)
    log_p[missed] = np.log10(prior[pair_word[missed]])

    # as the word before the next one; the end of a text is before none
    is_end = words == np.uint64(word_hash(END) + (1 << 63))
    later = np.where(is_end, 0.0, np.log10(total + PRIOR))
    size = len(rid)
    sums = [
        np.bincount(text, each, size).astype(np.int64), np.bincount(text, (total > 0)[at] * each, size).astype(np.int64),
        np.bincount(text, np.log10(total + 0.5)[at] * each, size), np.bincount(text, (log_p[pair] - later[at]) * each, size),
    ]
    return [
        zstandard.compress(pickle.dumps([np.diff(rid[i:j], prepend=0), *(x[i:j] for x in (doc_id, known_id, held, *sums))], protocol=5), 1)
        for i, j in zip(offsets, offsets[1:])
    ]


SCORED = "doc_id long, held_out boolean, n long, n_known long, base double, score double"


def add_up(packed: list[bytes]) -> list:
    """Columns of SCORED: one row for each text of a block, summed over the shards that scored its pairs."""
    import zstandard

    got = [pickle.loads(zstandard.decompress(p)) for p in packed]
    rid, first, at = np.unique(np.concatenate([np.cumsum(g[0]) for g in got]), return_index=True, return_inverse=True)
    doc_id, known, held, n, n_known, base, score = (np.concatenate([g[k] for g in got]) for k in range(1, 8))
    whole = lambda x: np.bincount(at, x, len(rid)).astype(np.int64)
    return [pa.array(doc_id[first], pa.int64(), mask=~known[first]), held[first], whole(n), whole(n_known), np.bincount(at, base, len(rid)), np.bincount(at, score, len(rid))]


def scores(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """The contract's row for every row of ``docs``.

    A shard gives back one packed row for each block, and a block adds up its own texts, so rows don't multiply with the
    number of shards."""
    plan = plan_shards(docs, saved(word_counts(docs), "word-counts"), shard)
    names = [f.split()[0] for f in SCORED.split(", ")]

    def one(table: pa.Table) -> pa.Table:
        return pa.table({"block": table.column("block"), "sums": pa.array(score_shard(table.column("pairs").to_pylist(), plan), pa.binary())})

    def whole(table: pa.Table) -> pa.Table:
        return pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in add_up(table.column("sums").to_pylist())], names)

    by_shard = pairs(docs, plan).groupBy("shard").applyInArrow(one, "block long, sums binary")
    rows = by_shard.groupBy("block").applyInArrow(whole, SCORED)
    start = math.log10(plan.texts + PRIOR)
    return rows.select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"), "n_known", F.lit(plan.tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n") * plan.log_unit).alias("base_score"), (F.col("score") - start).alias("score"),
    )


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(documents(spark, sf_dir))
