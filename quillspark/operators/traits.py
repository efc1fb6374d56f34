"""Score extraction on completion tables and per-essay trait aggregation.

Completions are kept in long form ``(essay_id, trait_idx, completion)``; the only shuffle of the
long table is the per-essay aggregation (on ``essay_id``), after the essay text has been pruned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import extract as X
from ..sources.tables import with_range
from .moments import stddev_samp


def with_trait_score(df: DataFrame, src: str = "completion", out: str = "trait_score",
                     pattern: str = C.TRAIT_SCORE_PATTERN, domain=C.TRAIT_DOMAIN) -> DataFrame:
    """First number of the leftmost pattern match, null outside ``domain`` (default 0..10)."""
    raw = f"__{out}_raw"
    bound = df.withColumn(raw, X.first_number(src, pattern))
    return bound.withColumn(out, X.in_range(raw, domain[0], domain[1])).drop(raw)


def with_fraction_score(df: DataFrame, spark, src: str = "msg_assistant", out: str = "score_pred",
                        domain: C.ScoreDomain = C.ASAP) -> DataFrame:
    """Overall score from a fraction (rescaled to the prompt's range) or an absolute integer.

    If a fraction matches, its value is final even when out of range; a zero denominator gives
    null. Otherwise the integer part of an absolute score is used. Result: nullable INT.
    """
    parts, absv, frac = f"__{out}_parts", f"__{out}_abs", f"__{out}_frac"
    d = with_range(df, spark, domain).withColumn(parts, X.fraction_parts(src))
    d = d.withColumn(absv, X.absolute_integer(src))
    num = X._to_double(F.try_element_at(F.col(parts), F.lit(1)))
    den = X._to_double(F.try_element_at(F.col(parts), F.lit(2)))
    scaled = F.try_add(F.try_multiply(F.try_divide(num, den), F.col("s_max") - F.col("s_min")), F.col("s_min"))
    d = d.withColumn(frac, F.bround(scaled, 0))
    lo, hi = F.col("s_min"), F.col("s_max")
    value = F.when(F.size(parts) >= 2, X.in_range(frac, lo, hi)).otherwise(X.in_range(F.bround(absv, 0), lo, hi))
    return d.withColumn(out, value.cast("int")).drop(parts, absv, frac, "s_min", "s_max")


def with_category(df: DataFrame, src: str = "msg_assistant", out: str = "proficiency_level_pred") -> DataFrame:
    return df.withColumn(out, X.category(src))


def coverage(df: DataFrame, value: str, group: str = "prompt_id") -> DataFrame:
    """Per group: rows, rows with a value, rows without. Rows of no group (null) are left out."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(value).alias("n_parsed"),
        (F.count(F.lit(1)) - F.count(value)).alias("n_missing"),
    )


def pivot_traits(df: DataFrame, keys, columns, trait: str = "trait_idx", n_traits: int = C.N_TRAITS,
                 name=lambda c, k: f"{c}_{k}") -> DataFrame:
    """Long -> wide: one row per ``keys`` with ``{column}_{k}`` for k = 1..n_traits.

    Conditional aggregation (what ``pivot`` compiles to) with explicit output names.
    """
    aggs = [
        F.first(F.when(F.col(trait) == k, F.col(c)), ignorenulls=True).alias(name(c, k))
        for c in columns for k in range(1, n_traits + 1)
    ]
    return df.groupBy(*keys).agg(*aggs)


def wide_traits(df: DataFrame, keys, value: str = "trait_score", trait: str = "trait_idx",
                n_traits: int = C.N_TRAITS) -> DataFrame:
    """Per essay ``trait1..traitN`` (numeric)."""
    aggs = [F.max(F.when(F.col(trait) == k, F.col(value))).alias(f"trait{k}") for k in range(1, n_traits + 1)]
    return df.groupBy(*keys).agg(*aggs)


def trait_mean(wide: DataFrame, out: str = "score_agg", n_traits: int = C.N_TRAITS) -> DataFrame:
    """Mean of the trait columns, null if any trait is null (summed left to right)."""
    total = F.col("trait1")
    for k in range(2, n_traits + 1):
        total = total + F.col(f"trait{k}")
    return wide.withColumn(out, total / F.lit(float(n_traits)))


def trait_std_weights(wide: DataFrame, group: str = "prompt_id", n_traits: int = C.N_TRAITS, count: str | None = None) -> DataFrame:
    """Per group ``w_k = std_k / sum_j std_j`` (sample std, nulls skipped), rounded to 12 places.

    The deviations come from exact sums (``moments``), whether rows are essays or counted cells, so bucket edges and
    half-even ties do not flip between runs or paths.
    """
    stds = wide.groupBy(group).agg(*[stddev_samp(f"trait{k}", count).alias(f"std{k}") for k in range(1, n_traits + 1)])
    total = F.col("std1")
    for k in range(2, n_traits + 1):
        total = total + F.col(f"std{k}")
    out = stds
    for k in range(1, n_traits + 1):
        out = out.withColumn(f"w{k}", F.round(F.try_divide(F.col(f"std{k}"), total), 12))
    return out.select(group, *[f"w{k}" for k in range(1, n_traits + 1)])


def trait_std_wsum(wide: DataFrame, group: str = "prompt_id", out: str = "score_agg",
                   n_traits: int = C.N_TRAITS, count: str | None = None) -> DataFrame:
    """Spread-weighted sum of the traits (weights per group from ``trait_std_weights``)."""
    w = trait_std_weights(wide, group, n_traits, count)  # one row per group; the planner broadcasts it if it is small
    total = F.col("w1") * F.col("trait1")
    for k in range(2, n_traits + 1):
        total = total + F.col(f"w{k}") * F.col(f"trait{k}")
    d = wide.join(w, group, "left")
    return d.withColumn(out, total).drop(*[f"w{k}" for k in range(1, n_traits + 1)])
