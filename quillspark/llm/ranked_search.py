"""Ranked lexical search, term at a time with limited accumulators (operator 12).

One scan writes a forward index: for each document its number of terms and the terms that the queries use, with their
counts. Document frequencies, the number of documents and the length of all texts come from that index. A second pass
inverts each batch of it and scores every query over the batch, term at a time from the rarest term on: an accumulator is
made for each document of a list until the bounds of the terms to come can't reach the kth partial score; from then on only
accumulators that can still reach it are updated, exactly. The kth score of a query grows over the batches of a task, so
later batches stop sooner. Each task hands out its ``k`` best of every query, and these are merged by Spark.

Queries are worked off in blocks of about ``BLOCK_BYTES`` of distinct terms, so what is sent to the tasks is bounded; every
block reads all documents.

Score: ``w * ((10^9 tf) div (1000 tf + 20 m))`` summed over the query's distinct terms, with
``w = floor(1000 ln((2N + 2) / (2 df + 1)))`` and ``m = 50 + (50 n N) div L``; N documents with a term, L their terms.

Defined results: a null text has no terms; such documents, and those of white space, aren't counted and never ranked. Rows
of ``docs`` are documents of their own, whatever their ids; a null doc_id sorts before all others. Rows of ``items`` with
one item_id (null: also one) are one query over all their terms. A query without terms, or whose terms no document holds,
has no rows. Equal scores stand by ascending doc_id. Other columns are ignored. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.sources.tables import read_table

from .common import ALNUM_TABLE, LOWER, UPPER, documents, map_batches, parts, saved, text_bytes

K = 50
#: Distinct terms of one block of queries, in bytes of text.
BLOCK_BYTES = 8 << 20
#: Stands for a null doc_id while documents are ranked.
NO_ID = -(1 << 63)

INDEX_SCHEMA = "doc_id long, n long, terms array<int>, counts array<int>"
BEST_SCHEMA = "query int, doc_id long, score long"


@dataclass(frozen=True)
class Queries:
    """One block: ``ids`` (item ids by query number), ``vocabulary`` (term to number) and each query's term numbers."""

    ids: list
    vocabulary: dict
    terms: list


def query_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Queries]:
    """The queries in blocks; which block a query is in depends on its id alone."""
    terms = items.select("item_id", F.explode(_terms()).alias("term")).distinct()
    whole = saved(terms.groupBy("item_id").agg(F.array_sort(F.collect_list("term")).alias("terms"), F.sum(F.length("term") + 8).alias("bytes")), "queries")
    n_blocks = int((whole.agg(F.sum("bytes")).first()[0] or 0) // block_bytes) + 1
    for b in range(n_blocks):
        rows = whole.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == b).select("item_id", "terms").toArrow()
        lists = [[t for t in x] for x in rows["terms"].to_pylist()]
        vocabulary = {t: i for i, t in enumerate(sorted({t for x in lists for t in x}))}
        if vocabulary:
            yield Queries(rows["item_id"].to_pylist(), vocabulary, [np.array([vocabulary[t] for t in x], np.int64) for x in lists])


def _terms():
    """Distinct terms of a text column, as binary (UTF-8)."""
    from .decontaminate import words

    return F.transform(F.array_distinct(words(F.col("text"))), lambda w: w.cast("binary"))


def build_index(docs: DataFrame, vocabulary: dict) -> DataFrame:
    """The forward index of the documents with a term, over the given vocabulary, written to the shared folder."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        number = known.value.get
        size = len(known.value)

        def work(batch: pa.RecordBatch) -> list:
            n, found, owner = [], [], []
            for i, raw in enumerate(batch.column("raw")):
                words = raw.as_py().translate(ALNUM_TABLE).split()
                n.append(len(words))
                here = np.array([x for x in map(number, words) if x is not None], np.int64)
                found.append(here)
                owner.append(np.full(len(here), i, np.int64))
            key, count = np.unique(np.concatenate(owner) * size + np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64),) * 2
            starts = np.searchsorted(key, np.arange(batch.num_rows + 1) * size).astype(np.int32)
            lists = lambda values: pa.ListArray.from_arrays(starts, pa.array(values.astype(np.int32)))
            return [batch.column("doc_id"), pa.array(n, pa.int64()), lists(key % size), lists(count)]

        return work

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), text_bytes().alias("raw"))
    return saved(map_batches(rows, INDEX_SCHEMA, make).where("n > 0"), "forward-index")


def term_weights(index: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Weight and document frequency by term number, N and L. One number per term of the block reaches the driver."""
    n_docs, length = index.agg(F.count("*"), F.sum("n")).first()
    counted = index.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
    df = np.zeros(size, np.int64)
    df[counted["term"].to_numpy()] = counted["count"].to_numpy()
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64), df, n_docs, length or 0


class Best:
    """The ``k`` best documents of one query so far, best first: score descending, doc_id ascending."""

    def __init__(self, k: int) -> None:
        self.k, self.score, self.doc = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def floor(self) -> int:
        """Score that a document needs at least."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        score, doc = np.concatenate([self.score, score]), np.concatenate([self.doc, doc])
        order = np.lexsort((doc, -score))[: self.k]
        self.score, self.doc = score[order], doc[order]


class Lists:
    """The inverted lists of one batch: of each term the documents that hold it, their impacts, and the largest of these."""

    def __init__(self, batch: pa.RecordBatch, size: int, n_docs: int, length: int) -> None:
        self.doc_id = batch.column("doc_id").to_numpy()
        m = 50 + (50 * batch.column("n").to_numpy() * n_docs) // length
        terms = batch.column("terms")
        owner = np.repeat(np.arange(batch.num_rows), np.diff(terms.offsets.to_numpy()))
        term, tf = terms.flatten().to_numpy(), batch.column("counts").flatten().to_numpy().astype(np.int64)
        order = np.argsort(term, kind="stable")
        self.owner, tf = owner[order], tf[order]
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[self.owner])
        self.starts = np.searchsorted(term[order], np.arange(size + 1))
        self.most = np.zeros(size, np.int64)
        held = np.flatnonzero(np.diff(self.starts))
        if len(held):
            self.most[held] = np.maximum.reduceat(self.impact, self.starts[held])


def search_batch(lists: Lists, terms: np.ndarray, weight: np.ndarray, best: Best) -> None:
    """Scores one query over a batch; ``terms`` stand from the rarest to the most frequent."""
    bound = weight[terms] * lists.most[terms]
    left = np.cumsum(bound[::-1])[::-1]  # of a term and all after it
    score = np.zeros(len(lists.doc_id), np.int64)
    made, need, alive = None, best.floor(), None
    for i, t in enumerate(terms):
        if bound[i] == 0:
            continue
        if alive is None and i:
            made = np.flatnonzero(score)
            if len(made) >= best.k:
                need = max(need, int(np.partition(score[made], -best.k)[-best.k]))
            if left[i] < need:  # no new document can reach the kth score any more
                alive = score + left[i] >= need
                alive &= score > 0
        if alive is None and left[i] < need:
            return  # nothing made so far, and nothing to come suffices
        if alive is not None and not alive.any():
            return
        here = slice(lists.starts[t], lists.starts[t + 1])
        who, add = lists.owner[here], weight[t] * lists.impact[here]
        if alive is not None:
            kept = alive[who]
            who, add = who[kept], add[kept]
        score[who] += add
    final = np.flatnonzero(score >= need)
    if alive is not None:
        final = final[alive[final]]
    best.add(score[final], lists.doc_id[final])


def search_block(docs: DataFrame, queries: Queries, k: int = K) -> DataFrame:
    """``query, doc_id, score``: of each task the ``k`` best documents of every query of the block."""
    size = len(queries.vocabulary)
    index = build_index(docs, queries.vocabulary)
    weight, df, n_docs, length = term_weights(index, size)
    plan = docs.sparkSession.sparkContext.broadcast((weight, [t[np.lexsort((t, df[t]))] for t in queries.terms]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, terms = plan.value
        best = [Best(k) for _ in terms]
        for batch in chain.from_iterable(map(parts, batches)):
            lists = Lists(batch, size, n_docs, length)
            for t, b in zip(terms, best):
                search_batch(lists, t, weight, b)
        query = np.repeat(np.arange(len(best), dtype=np.int32), [len(b.score) for b in best])
        yield pa.RecordBatch.from_arrays(
            [pa.array(query), pa.array(np.concatenate([b.doc for b in best])), pa.array(np.concatenate([b.score for b in best]))],
            names=["query", "doc_id", "score"],
        )

    return index.mapInArrow(run, BEST_SCHEMA)


def search(docs: DataFrame, items: DataFrame, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: of each item the ``k`` best documents."""
    spark, item_type = docs.sparkSession, items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id long, score long")
    for queries in query_blocks(items, block_bytes):
        order = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
        ranked = search_block(docs, queries, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(queries.ids)), f"query int, item_id {item_type}")  # a block of queries: bounded
        doc_id = F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id")
        out = out.unionByName(ranked.join(F.broadcast(names), "query").select("item_id", "rank", doc_id, "score"))
    return out


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir).select("doc_id", "text"), read_table(spark, sf_dir, "benchmark").select("item_id", "text"))


_TERMS = f"unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'))"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
p AS (SELECT r, doc_id, term, count(*) AS tf FROM (SELECT r, doc_id, {_TERMS} AS term FROM d) GROUP BY ALL),
l AS (SELECT r, cast(sum(tf) AS BIGINT) AS n FROM p GROUP BY r),
t AS (SELECT count(*) AS nn, cast(sum(n) AS BIGINT) AS ll FROM l),
f AS (SELECT term, cast(floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, t GROUP BY term),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, {_TERMS} AS term FROM benchmark)),
s AS (SELECT item_id, r, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll)))) AS BIGINT) AS score
      FROM q JOIN f USING (term) JOIN p USING (term) JOIN l USING (r), t GROUP BY ALL),
o AS (SELECT *, cast(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= {K}
"""
