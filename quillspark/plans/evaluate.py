"""End-to-end evaluation of model completions against human scores.

* numeric, single completion  : fraction/absolute extraction -> drop nulls -> kappa report
* numeric, multi-trait        : trait extraction -> trait mean -> (clip) min-max -> kappa report
* ordinal, single completion  : category extraction -> drop nulls -> ordinal kappa report
* ordinal, multi-trait        : trait extraction -> mean or spread-weighted sum -> (clip) min-max
                                -> level buckets -> ordinal kappa report

``score_*`` functions return the scored table (for saving, to a new path); ``eval_*`` return the
report ``(prompt_id STRING, n BIGINT, qwk DOUBLE)`` with a final ``average`` row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..operators import metrics as M
from ..operators import scaling as S
from ..operators import traits as T
from ..sources import sinks as SK


def score_vanilla_numeric(spark: SparkSession, df: DataFrame, domain: C.ScoreDomain = C.ASAP,
                          src: str = "msg_assistant") -> DataFrame:
    return T.with_fraction_score(df, spark, src=src, out="score_pred", domain=domain)


def score_vanilla_ordinal(df: DataFrame, src: str = "msg_assistant") -> DataFrame:
    return T.with_category(df, src=src, out="proficiency_level_pred")


def aggregate_traits(long_df: DataFrame, keys, agg_mode: str = "mean", pattern: str = C.TRAIT_SCORE_PATTERN,
                     src: str = "completion", group: str = "prompt_id", spark: SparkSession | None = None,
                     materialize: bool = False) -> DataFrame:
    """Long completions -> one row per essay with ``trait1..4`` and ``score_agg``.

    With ``materialize`` the per-essay trait table (a few numbers per essay) is written once: every
    later step (spread weights, per-prompt statistics, scaling) reads it, so the completions are
    scanned and parsed once.
    """
    scored = T.with_trait_score(long_df.select(*keys, "trait_idx", src), src=src, pattern=pattern)
    wide = T.wide_traits(scored, keys)
    if materialize:
        wide = SK.materialize(spark or long_df.sparkSession, wide, "per-essay-traits")
    if agg_mode == "mean":
        return T.trait_mean(wide)
    if agg_mode == "std_wsum":
        return T.trait_std_wsum(wide, group=group)
    raise ValueError(f"unknown agg_mode {agg_mode!r}")


def map_scores(spark: SparkSession, per_essay: DataFrame, domain: C.ScoreDomain, map_mode: str = "minmax",
               clip: bool = True) -> DataFrame:
    if map_mode == "minmax":
        return S.map_minmax(per_essay, spark, domain, clip=clip)
    if map_mode == "standard":
        return S.map_standard(per_essay, spark, domain)
    raise ValueError(f"unknown map_mode {map_mode!r}")


def mts_cells(spark: SparkSession, long_df: DataFrame, y1: str, domain: C.ScoreDomain, agg_mode: str = "mean",
              map_mode: str = "minmax", clip: bool = True, pattern: str = C.TRAIT_SCORE_PATTERN) -> DataFrame:
    """``(prompt_id, y1, score_map, c)``: how many essays have each human score and mapped score.

    All reports are functions of these cells. Behind the one shuffle by essay the essays are counted by the values that
    scaling reads (prompt, human score, aggregate or traits); spread weights, quartiles, extremes and the map itself
    then work on the cells, which are written once.
    """
    keys = ["essay_id", "prompt_id", y1]
    scored = T.with_trait_score(long_df.select(*keys, "trait_idx", "completion"), pattern=pattern)
    wide = T.wide_traits(scored, keys)
    if agg_mode == "mean":
        cells = T.trait_mean(wide).groupBy("prompt_id", y1, "score_agg").agg(F.count(F.lit(1)).alias("c"))
    elif agg_mode == "std_wsum":
        cells = wide.groupBy("prompt_id", y1, *[f"trait{k}" for k in range(1, C.N_TRAITS + 1)]).agg(F.count(F.lit(1)).alias("c"))
    else:
        raise ValueError(f"unknown agg_mode {agg_mode!r}")
    cells = SK.materialize(spark, cells, "cells")
    if agg_mode == "std_wsum":
        cells = T.trait_std_wsum(cells, count="c")
    if map_mode == "minmax":
        return S.map_minmax(cells, spark, domain, clip=clip, count="c")
    return map_scores(spark, cells, domain, map_mode)


def mts_numeric_cells(spark: SparkSession, long_df: DataFrame, domain: C.ScoreDomain = C.ASAP, **kw) -> DataFrame:
    cells = mts_cells(spark, long_df, "score", domain, **kw)
    return cells.select("prompt_id", "score", S.round_half_even_int("score_map").alias("score_pred"), "c")


def mts_ordinal_cells(spark: SparkSession, long_df: DataFrame, domain: C.ScoreDomain = C.TOEFL,
                      pattern: str = C.TRAIT_SCORE_PATTERN_ALT, **kw) -> DataFrame:
    cells = mts_cells(spark, long_df, "proficiency_level", domain, pattern=pattern, **kw)
    return cells.select("prompt_id", "proficiency_level", S.bucket_level("score_map").alias("proficiency_level_pred"), "c")


def score_mts_numeric(spark: SparkSession, long_df: DataFrame, domain: C.ScoreDomain = C.ASAP,
                      agg_mode: str = "mean", map_mode: str = "minmax", clip: bool = True,
                      keys=("essay_id", "prompt_id", "score"), materialize: bool = True) -> DataFrame:
    per_essay = aggregate_traits(long_df, list(keys), agg_mode, spark=spark, materialize=materialize)
    mapped = map_scores(spark, per_essay, domain, map_mode, clip)
    return mapped.withColumn("score_pred", S.round_half_even_int("score_map"))


def score_mts_ordinal(spark: SparkSession, long_df: DataFrame, domain: C.ScoreDomain = C.TOEFL,
                      agg_mode: str = "mean", map_mode: str = "minmax", clip: bool = True,
                      keys=("essay_id", "prompt_id", "proficiency_level"),
                      pattern: str = C.TRAIT_SCORE_PATTERN_ALT, materialize: bool = True) -> DataFrame:
    per_essay = aggregate_traits(long_df, list(keys), agg_mode, pattern=pattern, spark=spark, materialize=materialize)
    mapped = map_scores(spark, per_essay, domain, map_mode, clip)
    return mapped.withColumn("proficiency_level_pred", S.bucket_level("score_map"))


def kappa_report(spark: SparkSession, scored: DataFrame, y1: str, y2: str, domain: C.ScoreDomain,
                 save_to: str | None = None) -> DataFrame:
    """Drop rows without a prediction, kappa per prompt, macro average.

    ``save_to`` first writes the scored table to that (new) path and reports from the written copy,
    so scoring runs once for both outputs.
    """
    if save_to:
        scored.write.mode("errorifexists").parquet(save_to)
        scored = spark.read.parquet(save_to)
    kept = scored.dropna(subset=[y2])
    return M.macro_report(M.qwk(kept, spark, y1, y2, domain))


def eval_vanilla_numeric(spark: SparkSession, df: DataFrame, domain: C.ScoreDomain = C.ASAP,
                         save_to: str | None = None) -> DataFrame:
    return kappa_report(spark, score_vanilla_numeric(spark, df, domain), "score", "score_pred", domain, save_to)


def eval_mts_numeric(spark: SparkSession, long_df: DataFrame, domain: C.ScoreDomain = C.ASAP,
                     save_to: str | None = None, **kw) -> DataFrame:
    """With ``save_to`` the scored essays are written there; without, the report needs no essay-sized table."""
    if save_to:
        return kappa_report(spark, score_mts_numeric(spark, long_df, domain, **kw), "score", "score_pred", domain, save_to)
    cells = M.cells_of(mts_numeric_cells(spark, long_df, domain, **kw), "score", "score_pred", labels=domain.labels)
    return M.macro_report(M.qwk_from_cells(cells, spark, domain))


def eval_vanilla_ordinal(spark: SparkSession, df: DataFrame, domain: C.ScoreDomain = C.TOEFL,
                         src: str = "msg_assistant", save_to: str | None = None) -> DataFrame:
    scored = score_vanilla_ordinal(df, src)
    return kappa_report(spark, scored, "proficiency_level", "proficiency_level_pred", domain, save_to)


def eval_mts_ordinal(spark: SparkSession, long_df: DataFrame, domain: C.ScoreDomain = C.TOEFL,
                     save_to: str | None = None, **kw) -> DataFrame:
    if save_to:
        scored = score_mts_ordinal(spark, long_df, domain, **kw)
        return kappa_report(spark, scored, "proficiency_level", "proficiency_level_pred", domain, save_to)
    counted = mts_ordinal_cells(spark, long_df, domain, **kw)
    cells = M.cells_of(counted, "proficiency_level", "proficiency_level_pred", labels=domain.labels)
    return M.macro_report(M.qwk_from_cells(cells, spark, domain))
