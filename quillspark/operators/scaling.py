"""Per-prompt score scaling: standard map, IQR clipping, min-max to the prompt range, buckets.

Per-prompt statistics are computed by one ``groupBy(prompt).agg`` (map-side partial aggregation)
and broadcast back; a prompt group is never shipped to one task. Clipping is monotone, so the
min/max of the clipped scores equal the clipped min/max: quartiles, min and max come from the same
single pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..sources.tables import with_range
from .quantiles import exact_quantiles


def _clamp(x, lo, hi):
    return F.when(x < lo, lo).when(x > hi, hi).otherwise(x)


def score_stats(df: DataFrame, value: str = "score_agg", group: str = "prompt_id", count: str | None = None) -> DataFrame:
    """Exact quartiles (linear interpolation), IQR fences, raw min and max per group.

    Quartiles come from ``exact_quantiles`` (histogram + bucket refinement), so no task holds all
    distinct values of a prompt, whatever its size.
    """
    stats = exact_quantiles(df, group, value, [0.25, 0.75], names=["q1", "q3"], with_min_max=True, count=count)
    stats = stats.withColumnRenamed("min", "raw_min").withColumnRenamed("max", "raw_max")
    q1, q3 = F.col("q1"), F.col("q3")
    return stats.select(
        group,
        q1.alias("q1"),
        q3.alias("q3"),
        (q1 - (q3 - q1) * F.lit(C.IQR_WIDTH)).alias("fence_lo"),
        (q3 + (q3 - q1) * F.lit(C.IQR_WIDTH)).alias("fence_hi"),
        "raw_min",
        "raw_max",
    )


def bucket_level(x, labels=C.LEVEL_LABELS, edges=C.LEVEL_EDGES):
    """``< edges[0]`` -> labels[0], ``< edges[1]`` -> labels[1], else labels[2]; null stays null."""
    x = F.col(x) if isinstance(x, str) else x
    return (
        F.when(x < F.lit(edges[0]), F.lit(labels[0]))
        .when(x < F.lit(edges[1]), F.lit(labels[1]))
        .when(x.isNotNull(), F.lit(labels[2]))
    )


def round_half_even_int(x):
    x = F.col(x) if isinstance(x, str) else x
    return F.bround(x, 0).cast("int")


def map_standard(df: DataFrame, spark: SparkSession, domain: C.ScoreDomain = C.ASAP, value: str = "score_agg",
                 out: str = "score_map") -> DataFrame:
    """``x / 10 * (s_max - s_min) + s_min`` on the trait domain 0..10."""
    width = C.TRAIT_DOMAIN[1] - C.TRAIT_DOMAIN[0]
    mapped = (F.col(value) - F.lit(float(C.TRAIT_DOMAIN[0]))) / F.lit(float(width)) * (F.col("s_max") - F.col("s_min")) + F.col("s_min")
    return with_range(df, spark, domain).withColumn(out, mapped).drop("s_min", "s_max")


def map_minmax(df: DataFrame, spark: SparkSession, domain: C.ScoreDomain = C.ASAP, value: str = "score_agg",
               out: str = "score_map", clip: bool = True, group: str = "prompt_id", count: str | None = None) -> DataFrame:
    """Optional IQR clipping, then per-group min-max scaling to ``[s_min, s_max]``.

    A group whose (clipped) scores are all equal gets null (0/0), as does a null score and a row whose
    prompt has no range. No row is lost. ``count``: how many rows each row stands for.
    """
    scoped = with_range(df, spark, domain, group)
    if clip:
        stats = score_stats(scoped, value, group, count)
        stats = stats.select(
            group, "fence_lo", "fence_hi",
            _clamp(F.col("raw_min"), F.col("fence_lo"), F.col("fence_hi")).alias("s_lo"),
            _clamp(F.col("raw_max"), F.col("fence_lo"), F.col("fence_hi")).alias("s_hi"),
        )
    else:
        stats = scoped.where(F.col(group).isNotNull()).groupBy(group).agg(F.min(value).alias("s_lo"), F.max(value).alias("s_hi"))
    d = scoped.join(stats, group, "left")  # one row per prompt; the planner broadcasts it if it is small
    x = F.col(value)
    if clip:
        x = _clamp(x, F.col("fence_lo"), F.col("fence_hi"))
    unit = F.try_divide(x - F.col("s_lo"), F.col("s_hi") - F.col("s_lo"))
    mapped = unit * (F.col("s_max") - F.col("s_min")) + F.col("s_min")
    drop = ["s_lo", "s_hi", "s_min", "s_max"] + (["fence_lo", "fence_hi"] if clip else [])
    return d.withColumn(out, mapped).drop(*drop)
