"""Exact stratified sampling by hash rank, membership filtering and a representativeness test.

A row's rank key is ``md5(seed ':' id)``; a stratum keeps the rows of its ``k`` smallest (key, id) pairs. The k-th pair
is found from ids alone: ids are counted per ``(stratum, hash prefix)``, the boundary bucket that reaches ``k`` is found
on that small table, and only that bucket is ranked. The sample is then one filter over one scan of the rows: the cut of
each stratum (one row) is joined and compared. A stratum holding a third of the corpus is spread over all buckets.

By default ids that repeat count once, and every row of a sampled id is kept; ``unique_keys`` spares the deduplication
where ids are known to be unique.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..sources.sinks import materialize
from ..sources.tables import broadcast_if_small

PREFIX = 3


def hash_key(key: str = "essay_id", seed: int = C.SAMPLE_SEED):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def cuts(ids: DataFrame, k_of_size, stratum: str, key: str, seed: int, prefix: int = PREFIX) -> DataFrame:
    """``(stratum, __cut_h, __cut_k)``: the last (hash, id) pair that each stratum keeps; ``ids`` are distinct.

    ``prefix`` hex digits give 16 ** prefix buckets per stratum. Strata that keep nothing have no row.
    """
    h = ids.select(key, stratum).withColumn("__h", hash_key(key, seed)).withColumn("__b", F.substring("__h", 1, prefix))
    counts = h.groupBy(stratum, "__b").agg(F.count(F.lit(1)).alias("__c"))
    running = Window.partitionBy(stratum).orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.sum("__c").over(Window.partitionBy(stratum))
    cum = counts.select(stratum, "__b", (F.sum("__c").over(running) - F.col("__c")).alias("__before"), "__c", k_of_size(size).alias("__k"))
    edge = cum.where((F.col("__before") < F.col("__k")) & (F.col("__before") + F.col("__c") >= F.col("__k")))
    edge = edge.select(F.col(stratum).alias("__s"), F.col("__b").alias("__eb"), (F.col("__k") - F.col("__before")).alias("__take"))
    inside = h.join(edge, h[stratum].eqNullSafe(F.col("__s")) & (F.col("__b") == F.col("__eb")))
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy("__h", key))
    return inside.withColumn("__r", rank).where(F.col("__r") == F.col("__take")).select(
        F.col(stratum).alias("__s"), F.col("__h").alias("__cut_h"), F.col(key).alias("__cut_k"))


def _sample(df: DataFrame, k_of_size, stratum: str, key: str, seed: int, unique_keys: bool) -> DataFrame:
    """Rows of ``df`` at or below the cut of their stratum: one scan of ``df`` besides the one of its ids."""
    ids = df.select(key, stratum)
    if not unique_keys:
        ids = ids.groupBy(key).agg(F.min(stratum).alias(stratum))
    cut = broadcast_if_small(materialize(df.sparkSession, cuts(ids, k_of_size, stratum, key, seed), "cuts"))
    h = hash_key(key, seed)
    below = (h < F.col("__cut_h")) | ((h == F.col("__cut_h")) & (F.col(key) <= F.col("__cut_k")))
    return df.join(cut, df[stratum].eqNullSafe(F.col("__s")) & below, "left_semi")


def _frac_k(frac: float):
    return lambda size: F.bround(F.lit(float(frac)) * size, 0).cast("bigint")


def _n_k(n: int):
    def k(size):
        msg = F.concat(F.lit(f"stratum smaller than n={n}: size "), size.cast("string"))
        return F.when(size >= n, F.lit(n).cast("bigint")).otherwise(F.raise_error(msg).cast("bigint"))
    return k


def _sampled_ids(df, k, stratum, key, seed, unique_keys):
    ids = df.select(key, stratum)
    return _sample(ids if unique_keys else ids.dropDuplicates(), k, stratum, key, seed, unique_keys)


def sample_fraction(df: DataFrame, frac: float = C.SAMPLE_FRACTION, seed: int = C.SAMPLE_SEED,
                    stratum: str = "prompt_id", key: str = "essay_id", unique_keys: bool = False) -> DataFrame:
    """Distinct ``(key, stratum)`` of a stratified sample of exactly ``round_half_even(frac * n)`` ids per stratum,
    without replacement, reproducible for a seed."""
    return _sampled_ids(df, _frac_k(frac), stratum, key, seed, unique_keys)


def sample_n(df: DataFrame, n: int = C.SAMPLE_N, seed: int = C.SAMPLE_SEED,
             stratum: str = "prompt_id", key: str = "essay_id", unique_keys: bool = False) -> DataFrame:
    """Exactly ``n`` ids per stratum; a stratum with fewer is an error (raised in the job)."""
    return _sampled_ids(df, _n_k(n), stratum, key, seed, unique_keys)


def sample_rows(df: DataFrame, frac: float = C.SAMPLE_FRACTION, seed: int = C.SAMPLE_SEED,
                stratum: str = "prompt_id", key: str = "essay_id", unique_keys: bool = False) -> DataFrame:
    """The rows of the sampled ids (all columns, every copy), without joining ids back to the corpus."""
    return _sample(df, _frac_k(frac), stratum, key, seed, unique_keys)


def keep_sampled(df: DataFrame, sampled: DataFrame, key: str = "essay_id") -> DataFrame:
    """Rows of ``df`` whose key is in ``sampled`` (left semi join)."""
    return df.join(sampled.select(key), key, "left_semi")
