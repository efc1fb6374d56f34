"""Evaluation-side queries. Each name maps to a Spark callable ``(spark, sf_dir) -> DataFrame`` and,
where the result is SQL-expressible, to the DuckDB SQL that must give the same rows.

Every query reads the driver's tables (through the fixture adapters) in full.
"""

from __future__ import annotations


from pyspark.sql import functions as F

from .. import config as C
from ..operators import metrics as M
from ..operators import scaling as S
from ..operators import traits as T
from ..sources import fixtures as fx
from . import evaluate as E
from . import oracle as O

from .registry import register


# ------------------------------------------------------------------ shared oracle CTEs

TRAIT_LONG = {
    "t": f"select essay_id, prompt_id, score, proficiency_level, trait_idx, {O.first_number('completion')} as v0 from completions",
    "t2": f"select essay_id, prompt_id, score, proficiency_level, trait_idx, {O.in_range('v0', 0, 10)} as trait_score from t",
}


def _trait_long_alt():
    return {
        "t": f"select essay_id, prompt_id, score, proficiency_level, trait_idx, "
             f"{O.first_number('completion', C.TRAIT_SCORE_PATTERN_ALT)} as v0 from completions",
        "t2": TRAIT_LONG["t2"],
    }


def _wide(keys: str) -> str:
    traits = ", ".join(f"max(case when trait_idx = {k} then trait_score end) as trait{k}" for k in range(1, 5))
    return f"select {keys}, {traits} from t2 group by {keys}"


MEAN = "(((trait1 + trait2) + trait3) + trait4) / 4.0"


def _minmax_ctes(src: str, rng: str, clip: bool, out_cols: str) -> dict:
    """CTEs ``st`` (stats) and ``m`` (mapped) over relation ``src`` with ``score_agg``."""
    st = (f"select prompt_id, quantile_cont(score_agg, 0.25) as q1, quantile_cont(score_agg, 0.75) as q3, "
          f"min(score_agg) as mn, max(score_agg) as mx from {src} join {rng} using (prompt_id) group by prompt_id")
    fence = ("select prompt_id, q1 - (q3 - q1) * 1.5 as lo, q3 + (q3 - q1) * 1.5 as hi, mn, mx from st")
    if clip:
        lim = ("select prompt_id, lo, hi, case when mn < lo then lo when mn > hi then hi else mn end as s_lo, "
               "case when mx < lo then lo when mx > hi then hi else mx end as s_hi from fe")
        x = "case when score_agg < lo then lo when score_agg > hi then hi else score_agg end"
    else:
        lim = "select prompt_id, mn as s_lo, mx as s_hi from fe"
        x = "score_agg"
    m = (f"select {out_cols}, (({x}) - s_lo) / nullif(s_hi - s_lo, 0) * (s_max - s_min) + s_min as score_map "
         f"from {src} join lim using (prompt_id) join {rng} using (prompt_id)")
    return {"st": st, "fe": fence, "lim": lim, "m": m}


def _e2_scored_ctes(clip: bool = True) -> dict:
    c = dict(TRAIT_LONG)
    c["w"] = _wide("essay_id, prompt_id, score")
    c["a"] = f"select *, {MEAN} as score_agg from w"
    c.update(_minmax_ctes("a", "score_range", clip, "essay_id, prompt_id, score"))
    c["p"] = "select essay_id, prompt_id, score, score_map, cast(round_even(score_map, 0) as int) as score_pred from m"
    return c


def _numeric_pairs(src: str, y1: str, y2: str) -> str:
    return (f"select prompt_id, cast({y1} as bigint) as a, cast({y2} as bigint) as b from {src} join score_range using (prompt_id) "
            f"where {y2} is not null and {y1} between s_min and s_max and {y2} between s_min and s_max")


def _ordinal_pairs(src: str, y1: str, y2: str) -> str:
    return (f"select prompt_id, a, b from (select prompt_id, {O.ordinal(y1)} as a, {O.ordinal(y2)} as b from {src} "
            f"where {y2} is not null) q where a is not null and b is not null")


def _e4_scored_ctes(agg_mode: str = "mean") -> dict:
    c = _trait_long_alt()
    c["w"] = _wide("essay_id, prompt_id, proficiency_level")
    if agg_mode == "mean":
        c["a"] = f"select *, {MEAN} as score_agg from w"
    else:
        c.update(_wsum_ctes("w"))
    c.update(_minmax_ctes("a", "toefl_range", True, "essay_id, prompt_id, proficiency_level"))
    c["p"] = f"select essay_id, prompt_id, proficiency_level, score_map, {O.bucket('score_map')} as proficiency_level_pred from m"
    return c


def _wsum_ctes(src: str) -> dict:
    sd = ", ".join(f"stddev_samp(trait{k}) as std{k}" for k in range(1, 5))
    tot = "(((std1 + std2) + std3) + std4)"
    ws = ", ".join(f"round(std{k} / nullif({tot}, 0), 12) as w{k}" for k in range(1, 5))
    expr = "(((w1 * trait1 + w2 * trait2) + w3 * trait3) + w4 * trait4)"
    return {
        "sd": f"select prompt_id, {sd} from {src} group by prompt_id",
        "ww": f"select prompt_id, {ws} from sd",
        "a": f"select {src}.*, {expr} as score_agg from {src} join ww using (prompt_id)",
    }


# ------------------------------------------------------------------ evaluation

@register("eval_mts_numeric", O.with_fixtures(O.macro_report_sql("per"), "completions", ctes={
    **_e2_scored_ctes(), "pairs": _numeric_pairs("p", "score", "score_pred"), "per": O.qwk_from_pairs("pairs")}))
def q_eval_mts_numeric(spark, sf):
    return E.eval_mts_numeric(spark, fx.completions(spark, sf))


def _fraction_sql(col: str) -> str:
    parts = f"regexp_extract_all(regexp_extract({col}, {O.sql_str(C.FRACTION_PATTERN)}, 0), {O.sql_str(C.NUMBER_PATTERN)}, 0)"
    absv = (f"round_even(try_cast(nullif(regexp_extract(regexp_extract({col}, {O.sql_str(C.ABSOLUTE_PATTERN)}, 0), "
            f"{O.sql_str(C.INTEGER_PATTERN)}, 0), '') as double), 0)")
    return parts, absv


def _vanilla_scored_ctes() -> dict:
    parts, absv = _fraction_sql("msg_assistant")
    return {
        "v1": f"select v.*, s_min, s_max, {parts} as parts, {absv} as ab from vanilla v join score_range using (prompt_id)",
        "v2": ("select *, round_even(try_cast(parts[1] as double) / nullif(try_cast(parts[2] as double), 0) "
               "* (s_max - s_min) + s_min, 0) as fr from v1"),
        "p": ("select essay_id, prompt_id, score, cast(case when len(parts) >= 2 then "
              "(case when fr >= s_min and fr <= s_max then fr end) "
              "else (case when ab >= s_min and ab <= s_max then ab end) end as int) as score_pred from v2"),
    }


@register("eval_vanilla_numeric", O.with_fixtures(O.macro_report_sql("per"), "vanilla", ctes={
    **_vanilla_scored_ctes(), "pairs": _numeric_pairs("p", "score", "score_pred"), "per": O.qwk_from_pairs("pairs")}))
def q_eval_vanilla_numeric(spark, sf):
    return E.eval_vanilla_numeric(spark, fx.vanilla(spark, sf))


@register("eval_vanilla_ordinal", O.with_fixtures(O.macro_report_sql("per"), "vanilla", ctes={
    "p": f"select essay_id, prompt_id, proficiency_level, {O.category('msg_category')} as proficiency_level_pred from vanilla",
    "pairs": _ordinal_pairs("p", "proficiency_level", "proficiency_level_pred"), "per": O.qwk_from_pairs("pairs")}))
def q_eval_vanilla_ordinal(spark, sf):
    return E.eval_vanilla_ordinal(spark, fx.vanilla(spark, sf), src="msg_category")


@register("eval_mts_ordinal", O.with_fixtures(O.macro_report_sql("per"), "completions", "toefl_range", ctes={
    **_e4_scored_ctes(), "pairs": _ordinal_pairs("p", "proficiency_level", "proficiency_level_pred"),
    "per": O.qwk_from_pairs("pairs")}))
def q_eval_mts_ordinal(spark, sf):
    return E.eval_mts_ordinal(spark, fx.completions(spark, sf))


@register("qwk_report", O.with_fixtures(O.macro_report_sql("per"), "completions", "toefl_range", ctes={
    **_e4_scored_ctes("std_wsum"), "pairs": _ordinal_pairs("p", "proficiency_level", "proficiency_level_pred"),
    "per": O.qwk_from_pairs("pairs")}))
def q_qwk_report(spark, sf):
    """Macro report of the ordinal multi-trait path with spread-weighted trait aggregation."""
    return E.eval_mts_ordinal(spark, fx.completions(spark, sf), agg_mode="std_wsum")


# ------------------------------------------------------------------ extraction

@register("extract_numeric", O.with_fixtures("select essay_id, trait_idx, trait_score from t2", "completions", ctes=TRAIT_LONG))
def q_extract_numeric(spark, sf):
    return T.with_trait_score(fx.completions(spark, sf)).select("essay_id", "trait_idx", "trait_score")


@register("extract_numeric_alt", O.with_fixtures("select essay_id, trait_idx, trait_score from t2", "completions",
                                                 ctes=_trait_long_alt()))
def q_extract_numeric_alt(spark, sf):
    d = T.with_trait_score(fx.completions(spark, sf), pattern=C.TRAIT_SCORE_PATTERN_ALT)
    return d.select("essay_id", "trait_idx", "trait_score")


@register("score_in_range", O.with_fixtures("select essay_id, trait_idx, v0 as raw_score, trait_score from t2 join t using (essay_id, trait_idx)",
                                            "completions", ctes=TRAIT_LONG))
def q_score_in_range(spark, sf):
    from ..functions import extract as X
    d = fx.completions(spark, sf).withColumn("raw_score", X.first_number("completion"))
    d = d.withColumn("trait_score", X.in_range("raw_score", *C.TRAIT_DOMAIN))
    return d.select("essay_id", "trait_idx", "raw_score", "trait_score")


@register("extract_fraction", O.with_fixtures("select essay_id, prompt_id, score_pred from p", "vanilla", ctes=_vanilla_scored_ctes()))
def q_extract_fraction(spark, sf):
    return E.score_vanilla_numeric(spark, fx.vanilla(spark, sf)).select("essay_id", "prompt_id", "score_pred")


@register("extract_category", O.with_fixtures(
    f"select essay_id, {O.category('msg_category')} as proficiency_level_pred from vanilla", "vanilla"))
def q_extract_category(spark, sf):
    return T.with_category(fx.vanilla(spark, sf), src="msg_category").select("essay_id", "proficiency_level_pred")


@register("extraction_coverage", O.with_fixtures(
    "select prompt_id, count(*) as n_rows, count(trait_score) as n_parsed, count(*) - count(trait_score) as n_missing "
    "from t2 group by prompt_id", "completions", ctes=TRAIT_LONG))
def q_extraction_coverage(spark, sf):
    return T.coverage(T.with_trait_score(fx.completions(spark, sf)), "trait_score")


# ------------------------------------------------------------------ trait aggregation (A2-A4)

@register("trait_mean", O.with_fixtures(f"select essay_id, prompt_id, trait1, trait2, trait3, trait4, {MEAN} as score_agg from w",
                                        "completions", ctes={**TRAIT_LONG, "w": _wide("essay_id, prompt_id")}))
def q_trait_mean(spark, sf):
    return E.aggregate_traits(fx.completions(spark, sf), ["essay_id", "prompt_id"], "mean")


@register("trait_std_wsum", O.with_fixtures("select essay_id, prompt_id, score_agg from a", "completions",
                                            ctes={**TRAIT_LONG, "w": _wide("essay_id, prompt_id"), **_wsum_ctes("w")}))
def q_trait_std_wsum(spark, sf):
    d = E.aggregate_traits(fx.completions(spark, sf), ["essay_id", "prompt_id"], "std_wsum", spark=spark, materialize=True)
    return d.select("essay_id", "prompt_id", "score_agg")


@register("iqr_fences", O.with_fixtures(
    "select prompt_id, q1, q3, lo as fence_lo, hi as fence_hi from st join fe using (prompt_id)", "completions",
    ctes={**_e2_scored_ctes()}))
def q_iqr_fences(spark, sf):
    per = E.aggregate_traits(fx.completions(spark, sf), ["essay_id", "prompt_id"], "mean", spark=spark, materialize=True)
    return S.score_stats(per).select("prompt_id", "q1", "q3", "fence_lo", "fence_hi")


# ------------------------------------------------------------------ scaling

@register("map_standard", O.with_fixtures(
    "select essay_id, prompt_id, score_map, cast(round_even(score_map, 0) as int) as score_pred from "
    "(select essay_id, prompt_id, (score_agg - 0) / 10.0 * (s_max - s_min) + s_min as score_map from a join score_range using (prompt_id)) q",
    "completions", ctes={**TRAIT_LONG, "w": _wide("essay_id, prompt_id"), "a": f"select *, {MEAN} as score_agg from w"}))
def q_map_standard(spark, sf):
    per = E.aggregate_traits(fx.completions(spark, sf), ["essay_id", "prompt_id"], "mean")
    m = S.map_standard(per, spark)
    return m.select("essay_id", "prompt_id", "score_map", S.round_half_even_int("score_map").alias("score_pred"))


@register("map_minmax_clip", O.with_fixtures("select essay_id, prompt_id, score_map, score_pred from p", "completions",
                                             ctes=_e2_scored_ctes(True)))
def q_map_minmax_clip(spark, sf):
    return E.score_mts_numeric(spark, fx.completions(spark, sf)).select("essay_id", "prompt_id", "score_map", "score_pred")


@register("map_minmax_noclip", O.with_fixtures("select essay_id, prompt_id, score_map, score_pred from p", "completions",
                                               ctes=_e2_scored_ctes(False)))
def q_map_minmax_noclip(spark, sf):
    d = E.score_mts_numeric(spark, fx.completions(spark, sf), clip=False)
    return d.select("essay_id", "prompt_id", "score_map", "score_pred")


@register("bucket_level", O.with_fixtures("select essay_id, prompt_id, score_map, proficiency_level_pred from p",
                                          "completions", "toefl_range", ctes=_e4_scored_ctes()))
def q_bucket_level(spark, sf):
    d = E.score_mts_ordinal(spark, fx.completions(spark, sf))
    return d.select("essay_id", "prompt_id", "score_map", "proficiency_level_pred")


# ------------------------------------------------------------------ metrics

@register("confusion_matrix", O.with_fixtures(
    "select prompt_id, score as y1, score_pred as y2, count(*) as n from p where score_pred is not null group by all",
    "completions", ctes=_e2_scored_ctes()))
def q_confusion_matrix(spark, sf):
    cells = M.cells_of(E.mts_numeric_cells(spark, fx.completions(spark, sf)), "score", "score_pred")
    return cells.select("prompt_id", F.col("a").alias("y1"), F.col("b").alias("y2"), F.col("c").alias("n"))


@register("qwk_numeric", O.with_fixtures("select * from per", "completions", ctes={
    **_e2_scored_ctes(), "pairs": _numeric_pairs("p", "score", "score_pred"), "per": O.qwk_from_pairs("pairs")}))
def q_qwk_numeric(spark, sf):
    cells = M.cells_of(E.mts_numeric_cells(spark, fx.completions(spark, sf)), "score", "score_pred")
    return M.qwk_from_cells(cells, spark, C.ASAP)


@register("qwk_ordinal", O.with_fixtures("select * from per", "vanilla", ctes={
    "p": f"select essay_id, prompt_id, proficiency_level, {O.category('msg_category')} as proficiency_level_pred from vanilla",
    "pairs": _ordinal_pairs("p", "proficiency_level", "proficiency_level_pred"), "per": O.qwk_from_pairs("pairs")}))
def q_qwk_ordinal(spark, sf):
    scored = E.score_vanilla_ordinal(fx.vanilla(spark, sf), src="msg_category").dropna(subset=["proficiency_level_pred"])
    return M.qwk(scored, spark, "proficiency_level", "proficiency_level_pred", C.TOEFL)


KENDALL_BRUTE = {
    "kp": "select prompt_id, essay_id, score as a, score_pred as b from p where score_pred is not null",
    "cs": ("select x.prompt_id, sum(sign(x.a - y.a) * sign(x.b - y.b)) as s from kp x join kp y "
           "on x.prompt_id = y.prompt_id and x.essay_id < y.essay_id group by x.prompt_id"),
    "nn": "select prompt_id, count(*) as n from kp group by prompt_id",
    "xt": "select prompt_id, sum(t * (t - 1) / 2) as xtie from (select prompt_id, a, count(*) as t from kp group by all) q group by prompt_id",
    "yt": "select prompt_id, sum(t * (t - 1) / 2) as ytie from (select prompt_id, b, count(*) as t from kp group by all) q group by prompt_id",
    "kt": ("select prompt_id, n, round_even(greatest(-1.0, least(1.0, case when n * (n - 1) / 2 - xtie > 0 and n * (n - 1) / 2 - ytie > 0 then "
           "cast(coalesce(s, 0) as double) / sqrt(cast(n * (n - 1) / 2 - xtie as double)) / sqrt(cast(n * (n - 1) / 2 - ytie as double)) end)), 3) "
           "as kendall_tau from nn left join cs using (prompt_id) join xt using (prompt_id) join yt using (prompt_id)"),
}


@register("kendall_tau", O.with_fixtures("select prompt_id, n, kendall_tau from kt", "completions",
                                         ctes={**_e2_scored_ctes(), **KENDALL_BRUTE}))
def q_kendall_tau(spark, sf):
    return M.tau_from_cells(M.cells_of(E.mts_numeric_cells(spark, fx.completions(spark, sf)), "score", "score_pred"))


@register("eval_report", O.with_fixtures(
    "select r.prompt_id, per.qwk, kt.kendall_tau from score_range r left join per using (prompt_id) left join kt using (prompt_id)",
    "completions", ctes={**_e2_scored_ctes(), "pairs": _numeric_pairs("p", "score", "score_pred"),
                         "per": O.qwk_from_pairs("pairs"), **KENDALL_BRUTE}))
def q_eval_report(spark, sf):
    cells = M.cells_of(E.mts_numeric_cells(spark, fx.completions(spark, sf)), "score", "score_pred")
    return M.report_from_cells(cells, spark, C.ASAP)


@register("dropped_report", O.with_fixtures(
    "select cast(prompt_id as varchar) as prompt_id, count(*) as n_rows, count(score_pred) as n_kept, "
    "count(*) - count(score_pred) as n_dropped from p group by prompt_id "
    "union all select 'all', count(*), count(score_pred), count(*) - count(score_pred) from p",
    "completions", ctes=_e2_scored_ctes()))
def q_dropped_report(spark, sf):
    return M.dropped_report(E.mts_numeric_cells(spark, fx.completions(spark, sf)), "score_pred", count="c")
