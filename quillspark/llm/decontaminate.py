"""Benchmark decontamination over a positional inverted index (operator 4), in DataFrame expressions only.

The index holds a posting (document, position, term) for each document word that the benchmark uses; it is written once,
straight from the scan, and every list is read from it. For each benchmark window the rarest term's list, shifted by the
term's place in the item, gives candidate alignments of item and document; the second rarest term's list thins them. What
is left is intersected with the lists of all terms of the item: a run of matching places as long as a window is an exact
occurrence. No text is shuffled.

Terms are the words of letters and digits after A-Z are lowered. A window is ``WINDOW`` consecutive words of an item; an
item of fewer words, but not none, is one window.

Defined results: a null text has no words; documents without words, or an empty benchmark, are not contaminated. Rows
with the same doc_id and text share a result, each row keeps its own; rows of one doc_id with other texts are other
documents. Items that repeat an item_id count once in ``n_items``; a null item_id still hits, but has no name and isn't
counted. Other columns are kept by :func:`drop_contaminated` and else ignored. Empty tables give empty tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.sources.tables import read_table

from .common import LOWER, UPPER, broadcast_rows, documents, lower_ascii, saved

WINDOW = 10
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Stands for a null doc_id inside the index.
NO_ID = -(1 << 63)
DOC = ("did", "text_hash")


def words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD, -1), lambda w: w != "")


def _doc() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"), F.xxhash64("text").alias("text_hash")]


@dataclass(frozen=True)
class Queries:
    """Items to look for: ``tokens`` (qid, off, term, size) and ``items`` (qid, item_id)."""

    tokens: DataFrame
    items: DataFrame


def read_items(benchmark: DataFrame) -> Queries:
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where("size(w) > 0").distinct()
    rows = saved(rows.select(F.monotonically_increasing_id().alias("qid"), "item_id", "w"), "items")
    tokens = rows.select("qid", F.size("w").alias("size"), F.posexplode("w").alias("off", "term"))
    return Queries(tokens, rows.select("qid", "item_id"))


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The postings ``did, text_hash, pos, term`` of the terms given (distinct), written to the shared folder."""
    postings = docs.select(*_doc(), F.posexplode(words(F.col("text"))).alias("pos", "term"))
    return saved(postings.join(broadcast_rows(terms), "term").select(*DOC, "pos", "term"), "postings")


def window_terms(index: DataFrame, queries: Queries, window: int = WINDOW) -> DataFrame:
    """``qid, begin, length, rank, off, term, count, known``: the terms of each window by how often the documents use
    them (never: first), and how many of them the documents use at all."""
    counts = index.groupBy("term").count()
    size = F.least(F.col("size"), F.lit(window))
    all_terms = queries.tokens.join(counts, "term", "left").withColumn("length", size)
    inside = all_terms.withColumn("begin", F.explode(F.sequence(F.greatest(F.lit(0), F.col("off") - F.col("length") + 1), F.least(F.col("off"), F.col("size") - F.col("length")))))
    w = Window.partitionBy("qid", "begin")
    ranked = inside.withColumn("rank", F.row_number().over(w.orderBy("count", "off"))).withColumn("known", F.count("count").over(w))
    return ranked.select("qid", "begin", "length", "rank", "off", "term", "count", "known")


def rarest_terms(index: DataFrame, queries: Queries, window: int = WINDOW) -> DataFrame:
    """``qid, begin, rank, off, term`` of the windows whose terms all come up in the documents; others can't occur."""
    return window_terms(index, queries, window).where("known = length").select("qid", "begin", "rank", "off", "term")


def candidates(index: DataFrame, ranked: DataFrame) -> DataFrame:
    """Alignments ``did, text_hash, qid, delta`` (document place less item place) where the two rarest terms of a window
    stand in their places."""
    first = saved(ranked.where("rank <= 2"), "rarest")
    one, two = first.where("rank = 1"), first.where("rank = 2").select("qid", "begin", F.col("off").alias("off2"), F.col("term").alias("term2"))
    anchors = one.join(two, ["qid", "begin"], "left")
    found = index.join(broadcast_rows(anchors), "term").select(*DOC, "qid", "begin", (F.col("pos") - F.col("off")).alias("delta"), "off2", "term2")
    found = found.where("delta + begin >= 0").select(*DOC, "qid", "delta", (F.col("delta") + F.col("off2")).alias("pos"), F.col("term2").alias("term")).distinct()
    second = index.join(broadcast_rows(two.select(F.col("term2").alias("term")).distinct()), "term", "left_semi")
    sure = found.where("term IS NULL")  # windows of one word
    return found.join(second, [*DOC, "pos", "term"], "left_semi").unionByName(sure).select(*DOC, "qid", "delta").distinct()


def occurrences(index: DataFrame, queries: Queries, window: int = WINDOW) -> DataFrame:
    """``did, text_hash, qid, lo, hi``: document words ``lo..hi-1`` that windows of the item cover in one piece."""
    aligned = saved(candidates(index, rarest_terms(index, queries, window)), "alignments")
    expected = aligned.join(broadcast_rows(queries.tokens), "qid").withColumn("pos", F.col("delta") + F.col("off")).where("pos >= 0")
    within = aligned.select(*DOC).distinct()
    hinted = broadcast_rows(within)
    postings = index.join(hinted, [*DOC], "left_semi") if hinted is not within else index
    matched = expected.join(postings, [*DOC, "pos", "term"], "left_semi")
    run = F.col("off") - F.row_number().over(Window.partitionBy(*DOC, "qid", "delta").orderBy("off"))
    runs = matched.withColumn("run", run).groupBy(*DOC, "qid", "delta", "run").agg(F.min("pos").alias("lo"), F.count("*").alias("n"), F.first("size").alias("size"))
    return runs.where(F.col("n") >= F.least(F.col("size"), F.lit(window))).select(*DOC, "qid", "lo", (F.col("lo") + F.col("n")).alias("hi"))


def near_matches(index: DataFrame, queries: Queries, slop: int = 2, missing: int = 1, window: int = WINDOW) -> DataFrame:
    """Proximity: ``did, text_hash, qid`` where a window's terms, all but ``missing`` of them, stand within ``slop`` words of
    their places relative to one of its ``missing + 1`` rarest terms. An item shorter than a window may miss none.

    Of the ``missing + 2`` rarest terms two must stand close together (one, if there are no two). Only around such places
    are the lists of the window's other terms looked up, by the steps of ``slop + 1`` words next to the wanted one.
    """
    ranked = window_terms(index, queries, window).withColumn("allowed", F.expr(f"cast(length * {missing} div {window} AS INT)"))
    ranked = saved(ranked.where("length - known <= allowed"), "near-terms")
    rare = ranked.where("count IS NOT NULL AND rank <= allowed + 2").select("qid", "begin", "rank", "off", "term", "length", "allowed")
    spot = [*DOC, "qid", "begin", "delta", "length", "allowed"]
    lists = index.join(broadcast_rows(rare), "term").withColumn("delta", F.col("pos") - F.col("off")).withColumn("bit", F.expr("shiftleft(1L, rank)"))
    around = Window.partitionBy(*DOC, "qid", "begin").orderBy("delta").rangeBetween(-slop, slop)
    close = lists.withColumn("seen", F.bit_count(F.bit_or("bit").over(around)))
    anchors = saved(close.where("rank <= allowed + 1 AND seen >= least(length, allowed + 2) - allowed").select(*spot).distinct(), "near-places")

    step = F.floor(F.col("pos") / (slop + 1))
    expected = anchors.join(broadcast_rows(ranked.select("qid", "begin", "off", "term")), ["qid", "begin"]).withColumn("pos", F.col("delta") + F.col("off"))
    expected = expected.select(*spot, "off", "term", F.col("pos").alias("wanted"), F.explode(F.array(step - 1, step, step + 1)).alias("step"))
    within = anchors.select(*DOC).distinct()
    hinted = broadcast_rows(within)
    postings = (index.join(hinted, [*DOC], "left_semi") if hinted is not within else index).withColumn("step", step)
    there = expected.join(postings, [*DOC, "term", "step"]).where(F.abs(F.col("pos") - F.col("wanted")) <= slop)
    return there.groupBy(*spot).agg(F.countDistinct("off").alias("got")).where("got >= length - allowed").select(*DOC, "qid").distinct()


def search(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, Queries]:
    queries = read_items(benchmark)
    return occurrences(build_index(docs, queries.tokens.select("term").distinct()), queries, window), queries


def document_hits(found: DataFrame, queries: Queries) -> DataFrame:
    """``did, text_hash, n_hit, item_ids``: covered words of each document with an occurrence, and the items, sorted."""
    before = Window.partitionBy(*DOC).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.coalesce(F.max("hi").over(before), F.lit(0))
    covered = found.withColumn("new", F.greatest(F.lit(0), F.col("hi") - F.greatest("lo", upto))).groupBy(*DOC).agg(F.sum("new").alias("n_hit"))
    named = found.select(*DOC, "qid").distinct().join(broadcast_rows(queries.items), "qid").groupBy(*DOC).agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    return covered.join(named, [*DOC])


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's row for every row of ``docs``."""
    hits = document_hits(*search(docs, benchmark))
    rows = docs.select("doc_id", *_doc(), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    joined = rows.join(hits, [*DOC], "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items = F.coalesce("item_ids", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any benchmark window, with all their columns."""
    found, _ = search(docs.select("doc_id", "text"), benchmark)
    bad = broadcast_rows(saved(found.select(F.col("did").alias("_dc_id"), F.col("text_hash").alias("_dc_hash")).distinct(), "contaminated"))
    did, text_hash = F.coalesce(docs.doc_id.cast("long"), F.lit(NO_ID)), F.xxhash64(docs.text)
    return docs.join(bad, (did == bad["_dc_id"]) & (text_hash == bad["_dc_hash"]), "left_anti")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(documents(spark, sf_dir).select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT cast(item_id AS VARCHAR) AS item_id, w, least({WINDOW}, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS k FROM (SELECT *, unnest(generate_series(1, len(w) - n + 1)) AS i FROM b)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS k
       FROM (SELECT d.*, s.n, unnest(generate_series(1, len(w) - s.n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) AS s)),
hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.k = bw.k),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, cast(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
