"""Building the canonical scored corpus: overrides, rescoring, projection, keys and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import clean_text


def apply_overrides(spark: SparkSession, df: DataFrame, overrides, key: str = "essay_id",
                    column: str = "domain1_score") -> DataFrame:
    """Point fixes: ``overrides`` is a list of ``(key, value)`` held on the driver (a short, known
    list, so broadcasting it is safe); the override wins where present."""
    from ..sources.tables import local_table
    o = local_table(spark, [(k, float(v)) for k, v in overrides], [key, "__override"])
    out = df.join(F.broadcast(o), key, "left")
    return out.withColumn(column, F.coalesce(F.col("__override"), F.col(column))).drop("__override").select(*df.columns)


def weighted_rescore(df: DataFrame, prompt: int = C.RESCORED_PROMPT, group: str = "essay_set",
                     column: str = "domain1_score") -> DataFrame:
    """For one prompt, score = sum over both raters of ``2*t1 + t2 + t3 + t4``; null in any term -> null."""
    def rater(r):
        s = F.lit(2) * F.col(f"rater{r}_trait1")
        for t in (2, 3, 4):
            s = s + F.col(f"rater{r}_trait{t}")
        return s

    return df.withColumn(column, F.when(F.col(group) == prompt, rater(1) + rater(2)).otherwise(F.col(column)))


def canonical(df: DataFrame, clean: bool = True) -> DataFrame:
    """``(essay_id, prompt_id, essay, score INT)``; the score is truncated to int, a missing one is an error."""
    missing = F.raise_error(F.concat(F.lit("no score for essay "), F.coalesce(F.col("essay_id").cast("string"), F.lit("null"))))
    d = df.select(
        F.col("essay_id"),
        F.col("essay_set").cast("int").alias("prompt_id"),
        F.col("essay"),
        F.coalesce(F.col("domain1_score").cast("int"), missing.cast("int")).alias("score"),
    )
    return clean_text(d, "essay") if clean else d


def organize_rated_corpus(spark: SparkSession, raw: DataFrame, overrides=C.ASAP_SCORE_OVERRIDES) -> DataFrame:
    """Raw rated corpus -> canonical dataset: override, rescore prompt 7, clean, project."""
    return canonical(weighted_rescore(apply_overrides(spark, raw, overrides)))


def parse_prompt_id(c="prompt_id"):
    """``'P3'`` -> 3."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, r"P(\d)", "$1").try_cast("int")


def join_on(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner") -> DataFrame:
    """Equi-join on keys of different names; the right key is dropped.

    No broadcast hint: both sides may be corpus-sized (sort-merge); AQE switches to a broadcast
    at run time when the measured right side is small.
    """
    return left.join(right, left[left_key] == right[right_key], how).drop(right[right_key])


def distinct_by(df: DataFrame, key: str = "essay_id", keep=("prompt_id",), order: str | None = None) -> DataFrame:
    """One row per key over the key columns only (the text is pruned before the shuffle): of several rows the first by
    ``order`` (a column as ``sources.files.file_order`` gives), or else the one whose ``keep`` columns are least."""
    kept = F.struct(*keep)
    first = df.groupBy(key).agg((F.min_by(kept, order) if order else F.min(kept)).alias("__first"))
    return first.select(key, *[F.col(f"__first.{c}").alias(c) for c in keep])


def dense_index(spark: SparkSession, df: DataFrame, order_by: str, out: str = "essay_id",
                partitions: int | None = None) -> DataFrame:
    """Exact 0-based row number by ``order_by`` (nulls first) without a single-partition window.

    Rows are dealt out by range and sorted in their partition, written once, and numbered by partition offset plus
    place. Equal or null keys are told apart by their input place, so a hot key spreads over partitions as well; their
    order among themselves is arbitrary. Number a narrow table (keys only) and join texts to it afterwards.
    """
    from ..sources.sinks import materialize

    keys = (F.col(order_by), F.col("__place"))
    placed = df.withColumn("__place", F.monotonically_increasing_id())
    dealt = placed.repartitionByRange(partitions, *keys) if partitions else placed.repartitionByRange(*keys)
    rows = dealt.sortWithinPartitions(*keys).withColumn("__row", F.monotonically_increasing_id())
    rows = materialize(spark, rows.withColumn("__part", F.shiftright("__row", 33)).drop("__place"), "dense-index")
    # one row per partition: a table as small as the number of tasks that wrote it
    counts = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__row").alias("__first"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("__part", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"))
    return rows.join(F.broadcast(offsets), "__part").withColumn(out, F.col("__row") + F.col("__shift")).drop("__part", "__row", "__shift")


def attach_prompts(templates: DataFrame, prompts: DataFrame, key: str = "prompt_id") -> DataFrame:
    """Put the prompt text on each template row by prompt id (both sides: one row per prompt)."""
    t = templates.drop("prompt") if "prompt" in templates.columns else templates
    from ..sources.tables import broadcast_if_small
    return t.join(broadcast_if_small(prompts.select(key, "prompt")), key, "left")


def with_score_range(spark: SparkSession, df: DataFrame, domain: C.ScoreDomain = C.ASAP) -> DataFrame:
    """Attach ``s_min, s_max`` by prompt; rows of prompts without a range keep nulls."""
    from ..sources.tables import with_range
    return with_range(df, spark, domain)
