"""Substring dedup by repeated-phrase automata (operator 6).

A window is ``WINDOW`` consecutive words of one text; each word inside a window whose words also stand at an earlier
place (smaller doc_id, or earlier in the same text) goes.

Each window is named by its anchor: the least-hashed of its ``PHRASE``-word phrases, the leftmost of equals. Equal windows
have equal anchors, so only windows whose anchor phrase comes up twice in the corpus can recur. The neighbouring windows
that share an anchor make a passage. A passage that stood earlier word for word is repeated throughout. The different
passages of one anchor are confirmed in shards: windows that more than one of them holds are compiled to an Aho-Corasick
automaton, every passage of the shard is streamed through it to locate all occurrences, and each window stays at its
first place. The windows of an anchor with very many different passages are not gathered in a shard but grouped by their
words, pre-aggregated before the shuffle.

Each step is written to the scratch folder, and a step's table is removed once the next ones are written.

Defined results: a null or empty text has no words. Rows with the same doc_id and text are one document and get the same
result; rows of one doc_id with different texts are ordered by the hash of the text; a null doc_id comes first. Rows are
never dropped. Other columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.session import discard

from .common import documents, map_batches, saved, text_bytes
from .key_filter import KeyFilter, may_hold

WINDOW, PHRASE = 20, 8
#: Passages that one shard compiles on average, and different passages of an anchor beyond which its windows go apart.
SHARD, SPREAD = 4_000, 1_000
#: Stands for a null doc_id.
NO_ID = -(1 << 63)
#: A passage with more than one of so many equal shares of all passages is looked up without a shuffle of its copies.
PARTS = 2_000
PLACE, PIECE = "did long, text_hash long", ("did", "text_hash", "first", "words")
PASSAGE = f"anchor long, passage long, {PLACE}, first int, n int"


class WordCodes(dict):
    """A 64-bit hash of each word met."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def rolled(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` codes."""
    out = np.zeros(len(codes) - size + 1, np.uint64)
    for j in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + len(out)]
    return mixed(out)


#: Low bits of a phrase's hash that make room for its place while the least is looked for.
PLACE_BITS = 20


def passages(codes: np.ndarray, lengths: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(anchor hash, first window, number of windows)`` of each passage, given the codes of a text's words, and the
    hashes of its phrases. ``lengths``: the codes are those of several texts of so many words, one after the other."""
    lengths = np.array([len(codes)]) if lengths is None else lengths
    n = len(codes) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    phrases = rolled(codes, PHRASE)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = (phrases & ~low) | (np.arange(len(phrases), dtype=np.uint64) & low)
    width, span = 1, WINDOW - PHRASE + 1
    while 2 * width <= span:  # least of twice as many phrases
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:n], least[span - width : span - width + n])
    owner = np.repeat(np.arange(len(lengths)), lengths)
    inside = np.nonzero(owner[:n] == owner[WINDOW - 1 :])[0]  # a window lies in one text
    if not len(inside):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), phrases
    least, owner = least[inside], owner[inside]
    begin = np.nonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])]))[0]
    first = inside[begin]
    place = first + ((least[begin] & low).astype(np.int64) - first) % (1 << PLACE_BITS)
    return phrases[place], first, np.diff(begin, append=len(inside)), phrases


def passage_hash(phrases: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A hash of the words of each passage, from the hashes of phrases that cover them and its length."""
    out = mixed(count.astype(np.uint64))
    for j in (0, 7, 12):  # phrases 0, 7, 12 of the first and of the last window cover every word of a passage
        out = mixed(out ^ phrases[first + j]) + mixed(phrases[first + count - 1 + j])
    return mixed(out)


def _rows(docs: DataFrame) -> DataFrame:
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did")
    return docs.select(did, F.xxhash64("text").alias("text_hash"), text_bytes().alias("text"))


def all_passages(docs: DataFrame) -> DataFrame:
    """``anchor, passage, did, text_hash, first, n`` of every passage."""
    def make():
        known = WordCodes()

        def work(batch: pa.RecordBatch) -> list:
            words = [t.split() for t in batch.column("text").to_pylist()]
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            codes = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.uint64, int(lengths.sum()))
            anchor, first, count, phrases = passages(codes, lengths)
            passage = passage_hash(phrases, first, count) if len(first) else anchor
            ends = np.cumsum(lengths)
            owner = np.searchsorted(ends, first, "right")
            places = [batch.column(c).to_numpy()[owner] for c in ("did", "text_hash")]
            return [anchor.view(np.int64), passage.view(np.int64), *places, (first - (ends - lengths)[owner]).astype(np.int32), count.astype(np.int32)]

        return work

    return map_batches(_rows(docs), PASSAGE, make)


def maybe_recurring(found: DataFrame, wanted: KeyFilter) -> DataFrame:
    """The passages whose anchor the filter may hold."""
    held, bits = wanted.tester()

    def run(batches):
        bitmap = np.frombuffer(held.value, np.uint64)
        for batch in batches:
            yield batch.filter(pa.array(may_hold(bitmap, bits, batch.column("anchor").to_numpy())))

    return found.mapInArrow(run, PASSAGE)


def passage_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``anchor, did, text_hash, first, words, count`` of the passages ``chosen`` (``anchor, did, text_hash, first, n, count``),
    cut from their texts. Rows of equal id and text are one text."""
    wanted = chosen.groupBy("did", "text_hash").agg(F.collect_list(F.struct("anchor", "first", "n", "count")).alias("found"))
    texts = _rows(docs).groupBy("did", "text_hash").agg(F.first("text").alias("text"))

    def make():
        def work(batch: pa.RecordBatch) -> list:
            found = batch.column("found")
            each = found.value_lengths().to_numpy()
            anchor, first, n, count = found.flatten().flatten()
            spans, out = iter(zip(first.to_pylist(), n.to_pylist())), []
            for text, k in zip(batch.column("text").to_pylist(), each.tolist()):
                words = text.split()
                out += [b" ".join(words[a : a + m + WINDOW - 1]) for a, m in islice(spans, k)]
            owner = np.repeat(np.arange(len(each)), each)
            return [anchor, *(batch.column(c).to_numpy()[owner] for c in ("did", "text_hash")), first, out, count]

        return work

    return map_batches(texts.join(wanted, ["did", "text_hash"]), f"anchor long, {PLACE}, first int, words binary, count long", make)


def repeated_windows(pieces: list[tuple[tuple, list[bytes]]]) -> list[tuple[tuple, int]]:
    """``(place, offset)`` of the windows of the pieces that stand at an earlier place as well.

    ``pieces``: ``(place, words)`` with sortable places ``(did, text_hash, first)``. Windows of more than one place are
    compiled to an automaton over one character per distinct word; each piece is streamed through it.
    """
    import ahocorasick

    codes: dict[bytes, str] = {}
    texts = []
    for _, words in pieces:
        for w in words:
            if w not in codes:
                n = len(codes) + 1
                codes[w] = chr(n if n < 0xD800 else n + 0x800)
        texts.append("".join(map(codes.__getitem__, words)))
    seen = Counter(t[i : i + WINDOW] for t in texts for i in range(len(t) - WINDOW + 1))
    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, window in enumerate(w for w, n in seen.items() if n > 1):
        machine.add_word(window, k)
    if not len(machine):
        return []
    machine.make_automaton()
    found = [[(end - WINDOW + 1, k) for end, k in machine.iter(t)] for t in texts]
    earliest: dict[int, tuple] = {}
    for ((did, text_hash, first), _), places in zip(pieces, found):
        for offset, k in places:
            here = (did, text_hash, first + offset)
            if k not in earliest or here < earliest[k]:
                earliest[k] = here
    return [((did, text_hash, first), offset) for ((did, text_hash, first), _), places in zip(pieces, found) for offset, k in places if earliest[k] != (did, text_hash, first + offset)]


def repeats(docs: DataFrame, shard: int = SHARD, spread: int = SPREAD, parts: int = PARTS) -> DataFrame:
    """``did, text_hash, first, n``: runs of windows that also stand earlier."""
    found = saved(all_passages(docs), "all-passages")
    recurring = saved(found.groupBy("anchor").count().where("count > 1").select("anchor"), "anchors")
    place = F.struct("did", "text_hash", "first")
    passage = saved(maybe_recurring(found, KeyFilter(recurring, "anchor")), "passages")
    discard(found, recurring)
    distinct = passage.groupBy("anchor", "passage").agg(F.min(place).alias("at"), F.min("n").alias("n"), F.count("*").alias("copies"))
    distinct = saved(distinct, "distinct-passages")

    # at most ``parts`` passages have more than one of ``parts`` equal shares of all rows: their copies need no shuffle
    share = passage.count() // parts + 1
    keys, copies = ["anchor", "passage"], distinct.where("copies > 1").select("anchor", "passage", "at", "copies")
    many = F.broadcast(copies.where(F.col("copies") > share).select(*keys, "at"))
    few = passage.join(many, keys, "left_anti").join(copies.where(F.col("copies") <= share).drop("copies"), keys)
    whole = few.unionByName(passage.join(many, keys)).where(place != F.col("at")).select("did", "text_hash", "first", "n")
    whole = saved(whole, "whole-passages")
    discard(passage)

    several = distinct.groupBy("anchor").count().where("count > 1")
    mixed_ = saved(distinct.join(several, "anchor").select("anchor", "at.*", "n", "count"), "mixed-passages")
    discard(distinct)
    shards = mixed_.count() // shard + 1
    pieces = saved(passage_texts(docs, mixed_), "pieces")
    discard(mixed_)

    def windows():
        def work(batch: pa.RecordBatch) -> list:
            out = [[] for _ in range(4)]
            for did, text_hash, first, text in zip(*(batch.column(c).to_pylist() for c in PIECE)):
                words = text.split()
                for i in range(len(words) - WINDOW + 1):
                    for column, x in zip(out, (did, text_hash, first + i, b" ".join(words[i : i + WINDOW]))):
                        column.append(x)
            return out

        return work

    spread_out = map_batches(pieces.where(F.col("count") > spread).select(*PIECE), f"{PLACE}, first int, words binary", windows)
    earliest = spread_out.groupBy("words").agg(F.min(place).alias("at"), F.count("*").alias("c")).where("c > 1")
    apart = spread_out.join(earliest, "words").where(place != F.col("at")).select("did", "text_hash", "first", F.lit(1).alias("n"))

    schema = f"{PLACE}, first int, n int"

    def one(table: pa.Table) -> pa.Table:
        rows = zip(*(table.column(c).to_pylist() for c in ("did", "text_hash", "first", "words")))
        got = [(d, h, first + offset) for (d, h, first), offset in repeated_windows([((d, h, first), words.split()) for d, h, first, words in rows])]
        columns = list(zip(*got)) if got else [[], [], []]
        return pa.table({"did": pa.array(columns[0], pa.int64()), "text_hash": pa.array(columns[1], pa.int64()), "first": pa.array(columns[2], pa.int32()), "n": pa.array([1] * len(got), pa.int32())})

    sharded = pieces.where(F.col("count") <= spread).select(F.pmod("anchor", F.lit(shards)).alias("shard"), *PIECE)
    return whole.unionByName(apart).unionByName(sharded.groupBy("shard").applyInArrow(one, schema))


def kept_words(words: list[bytes], firsts: list[int], counts: list[int]) -> list[bytes]:
    """The words outside the windows that begin at ``first .. first + count - 1``."""
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, np.array(firsts, np.int64), 1)
    np.add.at(gone, np.array(firsts, np.int64) + np.array(counts, np.int64) + WINDOW - 1, -1)
    keep = np.cumsum(gone)[:-1] == 0
    return [w for w, k in zip(words, keep.tolist()) if k]


def dedup(docs: DataFrame, shard: int = SHARD, spread: int = SPREAD, parts: int = PARTS) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept`` of every row; ``kept`` is the text that stays, joined by spaces."""
    found = repeats(docs, shard, spread, parts)
    runs = saved(found.groupBy("did", "text_hash").agg(F.collect_list("first").alias("firsts"), F.collect_list("n").alias("counts")), "repeats")
    discard(found)
    joined = _rows(docs).withColumn("doc_id", F.when(F.col("did") != NO_ID, F.col("did"))).join(runs, ["did", "text_hash"], "left")

    def make():
        def work(batch: pa.RecordBatch) -> list:
            out = [[], [], [], []]
            for text, firsts, counts in zip(*(batch.column(c).to_pylist() for c in ("text", "firsts", "counts"))):
                words = text.split()
                kept = kept_words(words, firsts, counts) if firsts else words
                text = b" ".join(kept)
                for column, x in zip(out, (len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), text)):
                    column.append(x)
            out[3] = pa.array(out[3], pa.binary()).cast(pa.string())
            return [batch.column("doc_id"), *out]

        return work

    return map_batches(joined.select("doc_id", "text", "firsts", "counts"), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string", make)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir).select("doc_id", "text")).drop("kept")


SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS k FROM (SELECT *, unnest(generate_series(1, len(w) - 19)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS o FROM s) WHERE o > 1),
g AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS p FROM r),
p AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM p ANTI JOIN g USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, cast(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
