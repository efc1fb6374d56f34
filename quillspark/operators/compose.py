"""Composing the model-input table: corpus x template, sampled, with filled messages.

Multi-trait composition unpivots the (one row per prompt) template to one row per
``(prompt, trait)`` and joins it to the corpus, so the corpus is read once and fanned out by the
join, never re-read per trait. Output stays long ``(essay_id, trait_idx, ...)``; ``to_wide`` gives
the ``name_{k}`` layout only for writing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import templates as TP
from ..sources.tables import broadcast_if_small
from . import sampling as SM
from .traits import pivot_traits


def join_template(corpus: DataFrame, template: DataFrame, key: str = "prompt_id") -> DataFrame:
    """Corpus x template on prompt id. The template has one row per prompt (a bounded table)."""
    return corpus.join(broadcast_if_small(template), key, "inner")


def unpivot_traits(template: DataFrame, n_traits: int = C.N_TRAITS) -> DataFrame:
    """``trait_k, description_k, rubric_k`` columns -> rows ``(trait_idx, trait, description, rubric)``."""
    args = ", ".join(f"{k}, trait_{k}, description_{k}, rubric_{k}" for k in range(1, n_traits + 1))
    keep = [c for c in template.columns
            if not any(c == f"{p}_{k}" for p in ("trait", "description", "rubric") for k in range(1, n_traits + 1))]
    return template.selectExpr(*keep, f"stack({n_traits}, {args}) as (trait_idx, trait, description, rubric)")


def sample_corpus(df: DataFrame, frac: float | None, seed: int, unique_keys: bool = False) -> DataFrame:
    """Stratified test sample by prompt over distinct essay ids; every row of a sampled id is kept, in one scan."""
    return df if frac is None else SM.sample_rows(df, frac, seed, unique_keys=unique_keys)


def compose_vanilla(corpus: DataFrame, template: DataFrame, frac: float | None = C.SAMPLE_FRACTION,
                    seed: int = C.SAMPLE_SEED, unique_keys: bool = False) -> DataFrame:
    """Sample (optional), join the template, fill the instruction (``@prompt``, ``@essay`` stripped)."""
    df = sample_corpus(join_template(corpus, template), frac, seed, unique_keys)
    return df.withColumn("msg_user_instruction", TP.instruction())


def compose_mts(corpus: DataFrame, template: DataFrame, frac: float | None = C.SAMPLE_FRACTION,
                seed: int = C.SAMPLE_SEED, unique_keys: bool = False) -> DataFrame:
    """Long ``(essay_id, prompt_id, trait_idx, ...)`` with ``msg_system``, ``msg_user_retrieval``,
    ``msg_user_score`` per trait."""
    if frac is not None:
        in_domain = corpus.join(broadcast_if_small(template.select("prompt_id")), "prompt_id", "left_semi")
        corpus = sample_corpus(in_domain, frac, seed, unique_keys)
    traits = unpivot_traits(template)
    df = corpus.join(broadcast_if_small(traits), "prompt_id", "inner")
    return df.select(
        *corpus.columns,
        "trait_idx",
        "trait",
        TP.system_message("msg_system_template", "trait", "description").alias("msg_system"),
        TP.retrieval_message("msg_user_retrieval_template", "prompt", "essay", "trait").alias("msg_user_retrieval"),
        TP.score_message("msg_user_score_template", "trait", "rubric").alias("msg_user_score"),
    )


def from_wide(wide: DataFrame, columns, n_traits: int = C.N_TRAITS, names=None) -> DataFrame:
    """``{column}_{k}`` for k = 1..n_traits -> rows ``(..., trait_idx, column)``: the inverse of ``to_wide``.

    One ``stack`` over one scan. ``names`` renames the columns in the long table.
    """
    names = names or columns
    gone = {f"{c}_{k}" for c in columns for k in range(1, n_traits + 1)}
    keep = [f"`{c}`" for c in wide.columns if c not in gone]
    args = ", ".join(", ".join([str(k), *(f"`{c}_{k}`" for c in columns)]) for k in range(1, n_traits + 1))
    return wide.selectExpr(*keep, f"stack({n_traits}, {args}) as (trait_idx, {', '.join(names)})")


def to_wide(long_df: DataFrame, keys, columns, n_traits: int = C.N_TRAITS) -> DataFrame:
    """Long per-trait columns -> ``{column}_{k}`` (for the written test set only)."""
    return pivot_traits(long_df, keys, columns, n_traits=n_traits)


def ztest_report(spark: SparkSession, corpus: DataFrame, frac: float = C.SAMPLE_FRACTION, seed: int = C.SAMPLE_SEED):
    """Per prompt, compare the sampled essays' mean score with the corpus (separate report)."""
    from .metrics import sample_ztest
    ids = SM.sample_fraction(corpus, frac, seed)
    return sample_ztest(corpus, SM.keep_sampled(corpus, ids))
