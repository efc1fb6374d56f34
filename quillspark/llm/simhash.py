"""SimHash near-dedup with pigeonring filtering (operator 7).

A text's fingerprint has a bit for each bit that over half of its shingle hashes set. With 64 bits in a ring of five
segments and at most four differing bits, two fingerprints that link have a segment from which on every chain of l
consecutive segments differs in at most l * 4 / 5 bits: none in the first, at most one in the first two, and so on. So
they agree in one segment and in a half of the next: ten keys find all candidates. Candidates of a key must then hold
the budgets of the longer chains, and last the whole Hamming distance.

Equal fingerprints are one class from the start. A key with many classes is dealt out in blocks, each pair of blocks to
a task of its own, which gives a spanning forest of its links instead of all pairs.

Defined results: a null or empty text has fingerprint zero; rows that repeat get the same class; a null doc_id never
names a component (a component of such rows only has a null name). Other columns are ignored. An empty table gives an
empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_TABLE, documents, map_batches, saved, text_bytes
from .components import components

SHINGLE, DISTANCE, SEED = 4, 4, 42
#: Bits of the ring's segments, lowest first.
SEGMENTS = (13, 13, 13, 13, 12)
#: Classes of a key that one block holds.
BLOCK = 1_000


def shingle_hashes(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """XXH64 of each space-joined shingle, a row of 8 bytes each; fewer words than a shingle are one shingle."""
    import xxhash

    text, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= size:
        return np.frombuffer(digest(text, SEED), np.uint8).reshape(1, 8)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-size].tolist()]
    return np.frombuffer(b"".join([digest(text[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist())]), np.uint8).reshape(-1, 8)


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The 64-bit fingerprint as a signed integer; zero for a text without words."""
    words = text.translate(LOWER_TABLE).split()
    if not words:
        return 0
    hashes = shingle_hashes(words, size)
    ones = sum(np.unpackbits(hashes[i : i + 65_536], axis=1).sum(axis=0, dtype=np.int64) for i in range(0, len(hashes), 65_536))
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id, text_hash, fp`` of every row."""
    def make():
        def work(batch: pa.RecordBatch) -> list:
            return [batch.column("doc_id"), batch.column("text_hash"), [fingerprint(t, size) for t in batch.column("text").to_pylist()]]

        return work

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), text_bytes().alias("text"))
    return map_batches(rows, "doc_id long, text_hash long, fp long", make)


def _places() -> list[tuple[int, int]]:
    out, at = [], 0
    for n in SEGMENTS:
        out.append((at, n))
        at += n
    return out


def _bits(fp: Column, at: int, n: int) -> Column:
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << n) - 1))


def ring_keys(fp: Column) -> Column:
    """Ten keys: for each start its segment and either half of the next segment."""
    places, keys = _places(), []
    for start in range(len(SEGMENTS)):
        (a, n), (b, m) = places[start], places[(start + 1) % len(SEGMENTS)]
        for half, (at, size) in enumerate(((b, m // 2), (b + m // 2, m - m // 2))):
            keys.append((_bits(fp, a, n) * 128 + _bits(fp, at, size)) * 16 + (start * 2 + half))
    return F.array(*keys)


def chain_masks(start: int) -> list[tuple[int, int]]:
    """Bit mask and budget of the chains of two and more segments from ``start``; the last is the whole ring."""
    places, mask, out = _places(), 0, []
    for l in range(1, len(SEGMENTS) + 1):
        at, n = places[(start + l - 1) % len(SEGMENTS)]
        mask |= ((1 << n) - 1) << at
        out.append((mask, l * DISTANCE // len(SEGMENTS)))
    return out[1:]


def block_links(a: np.ndarray, b: np.ndarray | None, start: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within ``a``, or between ``a`` and ``b``."""
    x, y = (a, a) if b is None else (a, b)
    differ = (x[:, None] ^ y[None, :]).view(np.uint64)
    linked = np.ones(differ.shape, bool)
    for mask, budget in chain_masks(start):
        linked &= np.bitwise_count(differ & np.uint64(mask)) <= budget
    nodes = a if b is None else np.concatenate([a, b])
    rows, columns = np.nonzero(np.triu(linked, 1) if b is None else linked)
    columns = columns if b is None else columns + len(a)
    root = np.arange(len(nodes))
    while len(rows):
        low = np.minimum(root[rows], root[columns])
        new = root.copy()
        np.minimum.at(new, rows, low)
        np.minimum.at(new, columns, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return [(int(nodes[i]), int(nodes[r])) for i, r in enumerate(root) if i != r]


def links(classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """``a, b``: edges that join the fingerprints (column ``fp``, distinct) of each component."""
    keyed = classes.select("fp", F.explode(ring_keys(F.col("fp"))).alias("key"))
    several = keyed.groupBy("key").count().where("count > 1").select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    dealt = keyed.join(several, "key").select("key", "fp", "blocks", F.pmod(F.xxhash64("fp"), "blocks").cast("int").alias("own"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    pairs = dealt.groupBy("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")).agg(F.collect_list(F.struct("own", "fp")).alias("members"))

    def make():
        def work(batch: pa.RecordBatch) -> list:
            members = batch.column("members")
            own, fps = (members.flatten().field(i).to_numpy() for i in (0, 1))
            ends = np.concatenate([[0], np.cumsum(members.value_lengths().to_numpy())])
            starts = batch.column("key").to_numpy() % 16 // 2
            lo, hi = batch.column("lo").to_pylist(), batch.column("hi").to_pylist()
            found = []
            for k, (i, j) in enumerate(zip(ends, ends[1:])):
                f = fps[i:j]
                if lo[k] == hi[k]:
                    if j - i > 1:
                        found += block_links(f, None, int(starts[k]))
                elif (left := own[i:j] == lo[k]).any() and not left.all():
                    found += block_links(f[left], f[~left], int(starts[k]))
            return [[x for x, _ in found], [y for _, y in found]]

        return work

    return map_batches(pairs, "a long, b long", make)


def near_classes(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id, text_hash, fp, component, component_id`` of every row; ``component_id`` is the component's least doc_id."""
    prints = saved(fingerprints(docs, size), "fingerprints")
    classes = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    joined = components(links(classes))
    named = classes.join(joined, classes.fp == joined.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    return prints.join(named.join(least, "component").select("fp", "component", "component_id"), "fp")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, that of least doc_id (then of least text hash)."""
    found = near_classes(docs.select("doc_id", "text")).where("doc_id <=> component_id")
    first = found.groupBy("component").agg(F.min(F.struct("text_hash", "doc_id")).alias("kept"))
    copies = found.join(first, ["component"]).where("text_hash = kept.text_hash").groupBy("component").count().where("count > 1")
    kept = first.select(F.col("kept.doc_id").alias("kept_id"), F.col("kept.text_hash").alias("kept_hash"))
    out = docs.join(kept, docs.doc_id.eqNullSafe(kept.kept_id) & (F.xxhash64(docs.text) == kept.kept_hash), "left_semi")
    return out.dropDuplicates(["doc_id", "text"]) if copies.limit(1).count() else out  # no shuffle of texts where no row repeats


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_classes(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
