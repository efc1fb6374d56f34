"""Learned quality rules (operator 1): a decision list of threshold conjunctions, found by sequential covering.

The counts of ``text_stats`` give ratios; from labelled documents, rules that reject are grown one condition at a time
on two thirds of the sample, pruned on the rest, and the rows they cover are taken away before the next rule. The list
becomes one ordered Spark CASE expression.

The rules are fitted on a sample of at most ``SAMPLE`` labelled documents (those with the smallest hash of doc_id), a
bound that does not depend on the input; everything else covers all documents.

Defined results: a null text has no words; counts of an empty text are 0 and ratios of it 0, so it fails the base rule.
Rows that repeat are judged one by one. Several labels of one document count by majority (a tie is 0); null labels and
ids are left out. Without labels, or with one class only, the list is empty and only the base rule rejects. Other
columns of the input are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.tables import read_table

from . import text_stats
from .common import documents, map_batches, text_bytes

#: Most labelled documents that rules are fitted on.
SAMPLE = 20_000

RATIOS = {
    "symbol_ratio": "n_symbols / greatest(word_chars, 1)",
    "upper_ratio": "n_upper / greatest(word_chars, 1)",
    "digit_ratio": "n_digits / greatest(word_chars, 1)",
    "mark_ratio": "n_marks / greatest(word_chars, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_ratio": "n_repeat_words / greatest(n_words, 1)",
    "distinct_ratio": "n_distinct / greatest(n_words, 1)",
    "run_ratio": "n_runs / greatest(n_words, 1)",
    "bare_ratio": "n_bare / greatest(n_words, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
}


def document_stats(docs: DataFrame) -> DataFrame:
    """``doc_id``, the counts of ``text_stats`` (long) and the ratios of RATIOS (double)."""
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in text_stats.COUNTS)

    def make():
        def work(batch: pa.RecordBatch) -> list:
            rows = [text_stats.count(t) for t in batch.column("text").to_pylist()]
            return [batch.column("doc_id"), *(list(c) for c in zip(*rows))] if rows else [[] for _ in range(1 + len(text_stats.COUNTS))]

        return work

    stats = map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")), schema, make)
    return stats.select("*", *[F.expr(f"cast({e} AS double)").alias(n) for n, e in RATIOS.items()])


@dataclass(frozen=True)
class Condition:
    """``feature >= at`` or ``feature <= at``."""

    feature: str
    above: bool
    at: float

    def holds(self, data: dict[str, np.ndarray]) -> np.ndarray:
        return data[self.feature] >= self.at if self.above else data[self.feature] <= self.at

    def column(self) -> Column:
        return F.col(self.feature) >= self.at if self.above else F.col(self.feature) <= self.at


Rule = tuple[Condition, ...]


def covers(rule: Rule, data: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    for c in rule:
        rows = rows & c.holds(data)
    return rows


def _candidates(data: dict[str, np.ndarray], rows: np.ndarray, bins: int):
    for f, x in data.items():
        for at in np.unique(np.round(np.quantile(x[rows], np.linspace(0, 1, bins + 1)), 6)):
            yield Condition(f, True, float(at))
            yield Condition(f, False, float(at))


def grow(data: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray, most: int = 4, bins: int = 24) -> Rule:
    """Adds the condition of the largest FOIL gain until no wanted row is covered or nothing is gained."""
    rule: Rule = ()
    while len(rule) < most:
        p0, n0 = (rows & bad).sum(), (rows & ~bad).sum()
        if p0 == 0 or n0 == 0:
            break
        best, now = 0.0, None
        for c in _candidates(data, rows & bad, bins):
            hit = rows & c.holds(data)
            p, n = (hit & bad).sum(), (hit & ~bad).sum()
            gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))) if p else 0.0
            if gain > best + 1e-9:
                best, now = gain, c
        if now is None:
            break
        rule, rows = (*rule, now), rows & now.holds(data)
    return rule


def prune(rule: Rule, data: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> Rule:
    """The shortest head of the rule with the best (p - n) / (p + n) on rows that it wasn't grown on."""
    def worth(r: Rule) -> float:
        hit = covers(r, data, rows)
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)))


def learn(data: dict[str, np.ndarray], bad: np.ndarray, seed: int = 7, most: int = 12, precision: float = 0.9, least: int = 3) -> list[Rule]:
    """Sequential covering: ordered rules that reject. A rule must keep ``precision`` on all rows left and cover ``least`` bad ones."""
    if not len(bad) or bad.all() or not bad.any():
        return []
    growing = np.random.default_rng(seed).random(len(bad)) < 2 / 3
    left, rules = np.ones(len(bad), bool), []
    while len(rules) < most and (left & bad).any():
        rule = grow(data, bad, left & growing)
        if not rule:
            break
        rule = prune(rule, data, bad, left & ~growing)
        hit = covers(rule, data, left)
        if (hit & bad).sum() < least or (hit & bad).sum() < precision * hit.sum():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The ordered list as one CASE expression: false at the first rule that holds, else true."""
    out = F.lit(True) if not rules else None
    for rule in rules:
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = F.when(test, False) if out is None else out.when(test, False)
    return out.otherwise(True) if rules else out


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def labelled_ids(labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """At most ``most`` labelled ids: ``doc_id, quality boolean``."""
    one = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") > 0.5).alias("quality"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> list[Rule]:
    """Rules for the documents that the base rule lets pass, from a bounded sample."""
    known = labelled_ids(labels, most).toPandas()
    if known.empty:
        return []
    ids = F.broadcast(docs.sparkSession.createDataFrame(known[["doc_id"]]))  # at most ``most`` rows
    stats = document_stats(docs.select("doc_id", "text").join(ids, "doc_id")).where(~base_failed())
    got = stats.select("doc_id", *RATIOS).dropDuplicates(["doc_id"]).toPandas().merge(known, on="doc_id").sort_values("doc_id")
    return learn({f: got[f].to_numpy(float) for f in RATIOS}, ~got["quality"].to_numpy(bool))


def apply_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Counts, ratios, ``base_failed`` and ``kept`` of every document."""
    stats = document_stats(docs).withColumn("base_failed", base_failed())
    return stats.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), read_table(spark, sf_dir, "labels")
    judged = apply_rules(docs, fit(docs, labels))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
