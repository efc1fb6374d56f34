"""Queries over the awkward cases: unlisted and missing prompts, repeated ids, wide tables, files with other columns,
message-list prompts, scores inside long texts, saved tables. Same contract as ``catalog``."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..functions import templates as TP
from ..operators import compose as CO
from ..operators import infer as INF
from ..operators import metrics as M
from ..operators import sampling as SM
from ..operators import traits as T
from ..session import scratch_path
from ..sources import files as FL
from ..sources import fixtures as fx
from ..sources import sinks as SK
from . import catalog as K
from . import catalog_prep as P
from . import evaluate as E
from . import oracle as O
from . import organize as ORG
from .registry import register

WF = O.with_fixtures

# ------------------------------------------------------------------ prompts outside the listed ones


def _any_prompt(ctes: dict) -> dict:
    return {k: v.replace("from completions", "from completions_any").replace("toefl_range", "any_range") for k, v in ctes.items()}


ANY_RANGE = {"any_range": "select distinct prompt_id, 1 as s_min, 5 as s_max from completions_any where prompt_id is not null"}


@register("eval_mts_ordinal_any_prompt", WF(O.macro_report_sql("per"), "completions_any", ctes={
    **ANY_RANGE, **_any_prompt(K._e4_scored_ctes()), "pairs": K._ordinal_pairs("p", "proficiency_level", "proficiency_level_pred"),
    "per": O.qwk_from_pairs("pairs")}))
def q_eval_mts_ordinal_any_prompt(spark, sf):
    return E.eval_mts_ordinal(spark, fx.completions_any(spark, sf))


@register("dropped_report_domain", WF(
    "select case when grouping(prompt_id) = 1 then 'all' else coalesce(cast(prompt_id as varchar), 'none') end as prompt_id, count(*) as n_rows, "
    "count(score_pred) as n_kept, count(*) - count(score_pred) as n_dropped from p group by grouping sets ((prompt_id), ())",
    "score_range", "vanilla_any", ctes={
        "v1": K._vanilla_scored_ctes()["v1"].replace("from vanilla v join", "from vanilla_any v left join"),
        "v2": K._vanilla_scored_ctes()["v2"],
        "p": K._vanilla_scored_ctes()["p"].replace("select essay_id, prompt_id", "select essay_id, prompt_id")}))
def q_dropped_report_domain(spark, sf):
    """Prompts 9..12 have no score range, and some rows no prompt: all are counted as dropped."""
    return M.dropped_report(E.score_vanilla_numeric(spark, fx.vanilla_any(spark, sf)), "score_pred")


@register("map_standard_ordinal", WF(
    f"select essay_id, prompt_id, score_map, {O.bucket('score_map')} as proficiency_level_pred from "
    "(select essay_id, prompt_id, (score_agg - 0) / 10.0 * (s_max - s_min) + s_min as score_map from a join toefl_range using (prompt_id)) q",
    "completions", "toefl_range", ctes={**K._trait_long_alt(), "w": K._wide("essay_id, prompt_id, proficiency_level"),
                                        "a": f"select *, {K.MEAN} as score_agg from w"}))
def q_map_standard_ordinal(spark, sf):
    d = E.score_mts_ordinal(spark, fx.completions(spark, sf), map_mode="standard", materialize=False)
    return d.select("essay_id", "prompt_id", "score_map", "proficiency_level_pred")


# ------------------------------------------------------------------ wide completions and test sets

@register("eval_mts_wide", WF(O.macro_report_sql("per"), "completions", ctes={
    **K._e2_scored_ctes(), "pairs": K._numeric_pairs("p", "score", "score_pred"), "per": O.qwk_from_pairs("pairs")}))
def q_eval_mts_wide(spark, sf):
    """A written wide result table (``msg_assistant_score_{k}``) read back to long rows and evaluated."""
    long = fx.completions(spark, sf).withColumnRenamed("completion", "msg_assistant_score")
    wide = SK.materialize(spark, CO.to_wide(long, ["essay_id", "prompt_id", "score"], ["msg_assistant_score"]), "wide")
    return E.eval_mts_numeric(spark, CO.from_wide(wide, ["msg_assistant_score"], names=["completion"]))


WIDE_REPLIES = ", ".join(f"max(case when trait_idx = {k} then {c} end) as msg_assistant_{n}_{k}" for n, c in
                         (("retrieval", "completion"), ("score", "reply")) for k in range(1, 5))


@register("infer_wide", WF(
    f"select essay_id, prompt_id, {WIDE_REPLIES} from (select *, {O.stub_reply('prompt_score')} as reply from r3) q group by essay_id, prompt_id",
    "essays", "template_mts", ctes=P.TWO_TURN_SAMPLED))
def q_infer_wide(spark, sf):
    long = P._long(spark, sf, C.SAMPLE_FRACTION)
    wide = CO.to_wide(long, ["essay_id", "prompt_id"], ["msg_system", "msg_user_retrieval", "msg_user_score"])
    return INF.infer_wide(spark, wide)


# ------------------------------------------------------------------ message-list prompts

def _chat(*pieces: str) -> str:
    return "'<s>' || " + " || ".join(f"coalesce({p}, '')" for p in pieces)


USER_1 = "'[INST] ' || msg_system || chr(10) || msg_user_retrieval || ' [/INST]'"
USER_2 = "'[INST] ' || msg_user_score || ' [/INST]'"


@register("messages_two_turn", WF(
    f"select essay_id, trait_idx, {_chat(USER_1, "completion || '</s>'", USER_2)} as prompt from lg join completions c using (essay_id, trait_idx)",
    "essays", "template_mts", "completions", ctes=P.LONG_ALL))
def q_messages_two_turn(spark, sf):
    replies = fx.completions(spark, sf).select("essay_id", "trait_idx", F.col("completion").alias("msg_assistant_retrieval"))
    d = P._long(spark, sf).join(replies, ["essay_id", "trait_idx"])
    return d.select("essay_id", "trait_idx", TP.render_inst_chat(TP.messages_two_turn()).alias("prompt"))


@register("infer_vanilla_chat", WF(
    f"select essay_id, prompt_id, prompt, {O.stub_reply('prompt')} as msg_assistant from vc", "essays", "template_vanilla",
    ctes={**P.VAN_SAMPLED, "vc": f"select essay_id, prompt_id, {_chat("'[INST] ' || msg_system || chr(10) || ins || ' [/INST]'")} as prompt from vn"}))
def q_infer_vanilla_chat(spark, sf):
    d = INF.infer_vanilla(spark, P._vanilla_composed(spark, sf, C.SAMPLE_FRACTION), renderer=INF.CHAT)
    return d.select("essay_id", "prompt_id", "prompt", "msg_assistant")


@register("infer_two_turn_chat", WF(
    f"select essay_id, trait_idx, completion as msg_assistant_retrieval, {O.stub_reply('prompt_score')} as msg_assistant_score from c3",
    "essays", "template_mts", ctes={
        **P.LONG_SAMPLED,
        "c1": f"select lg.*, {_chat(USER_1)} as prompt_retrieval from lg",
        "c2": f"select c1.*, {O.stub_reply('prompt_retrieval')} as completion from c1",
        "c3": f"select c2.*, {_chat(USER_1, "completion || '</s>'", USER_2)} as prompt_score from c2"}))
def q_infer_two_turn_chat(spark, sf):
    d = INF.infer_two_turn(spark, P._long(spark, sf, C.SAMPLE_FRACTION), renderer=INF.CHAT)
    return d.select("essay_id", "trait_idx", "msg_assistant_retrieval", "msg_assistant_score")


# ------------------------------------------------------------------ repeated ids

DUPS = {"dup": "select * from essays union all select * from essays where essay_id % 3 = 0",
        "smp": O.sample_rank("(select distinct essay_id, prompt_id from dup)", C.SAMPLE_FRACTION, None, C.SAMPLE_SEED)}


def _dups(spark, sf):
    e = fx.essays(spark, sf).select("essay_id", "prompt_id", "essay", "score")
    return e.unionByName(e.where("essay_id % 3 = 0"))


@register("sample_frac_dups", WF("select essay_id, prompt_id from smp", "essays", ctes=DUPS))
def q_sample_frac_dups(spark, sf):
    return SM.sample_fraction(_dups(spark, sf))


@register("compose_mts_dups", WF(
    "select essay_id, prompt_id, trait_idx, msg_system, msg_user_retrieval, msg_user_score from lg", "essays", "template_mts",
    ctes={**DUPS, "tr": P.TRAITS_SQL, "es": "select * from dup where essay_id in (select essay_id from smp)", "lg": P.LONG_SQL.format(src="es")}))
def q_compose_mts_dups(spark, sf):
    d = CO.compose_mts(_dups(spark, sf), fx.template_mts(spark))
    return d.select("essay_id", "prompt_id", "trait_idx", "msg_system", "msg_user_retrieval", "msg_user_score")


# ------------------------------------------------------------------ scores inside long texts

@register("extract_numeric_long", WF(
    f"select essay_id, {O.in_range('v0', 0, 10)} as trait_score from (select essay_id, {O.first_number('completion')} as v0 from long_completions) q",
    "long_completions"))
def q_extract_numeric_long(spark, sf):
    return T.with_trait_score(fx.long_completions(spark, sf)).select("essay_id", "trait_score")


@register("extract_fraction_long", WF("select essay_id, prompt_id, score_pred from p", "long_completions", ctes={
    "v1": K._vanilla_scored_ctes()["v1"].replace("from vanilla v", "from (select *, 0 as score from long_completions) v"),
    "v2": K._vanilla_scored_ctes()["v2"], "p": K._vanilla_scored_ctes()["p"]}))
def q_extract_fraction_long(spark, sf):
    return E.score_vanilla_numeric(spark, fx.long_completions(spark, sf)).select("essay_id", "prompt_id", "score_pred")


# ------------------------------------------------------------------ files with other columns, templates, saved scores

@register("src_language_csv", "select concat(cast(doc_id as string), '.txt') as Filename, lang as Language from documents")
def q_src_language_csv(spark, sf):
    rows = fx.language_rows(spark, sf).select("Filename", F.col("Split").alias("Prompt"), F.lit("high").alias("Score Level"), "Language")
    return FL.read_languages(spark, SK.write_delimited(rows, scratch_path(spark, "languages"), header=True))


@register("src_rated_wide", WF("select * from raw_ratings", "raw_ratings"))
def q_src_rated_wide(spark, sf):
    raw = fx.raw_ratings(spark, sf)
    rows = raw.select(*reversed(raw.columns), F.lit("x").alias("rater3_domain1"), F.lit(7).alias("domain2_score"))
    path = SK.write_delimited(rows, scratch_path(spark, "rated-wide"), sep="\t", header=True)
    return FL.read_rated_corpus(spark, path, multi_line=True)


@register("src_templates", WF(
    "select essay_id, prompt_id, score, prompt, msg_user_retrieval_template, trait_1, rubric_1 from essays join template_mts using (prompt_id)",
    "essays", "template_mts"))
def q_src_templates(spark, sf):
    """A written dataset and a written template table, read back and joined."""
    data = SK.materialize(spark, fx.essays(spark, sf).select("essay_id", "prompt_id", "score"), "dataset")
    path = SK.write_delimited(fx.template_mts(spark), scratch_path(spark, "templates"), header=True)
    d = CO.join_template(data, FL.read_templates(spark, path, "mts"))
    return d.select("essay_id", "prompt_id", "score", "prompt", "msg_user_retrieval_template", "trait_1", "rubric_1")


@register("sink_templates", WF(
    "select t.prompt_id, p.prompt, t.msg_system_template, t.trait_4 from template_mts t left join pr p using (prompt_id)",
    "template_mts", ctes={"pr": P.PROMPTS_SQL}))
def q_sink_templates(spark, sf):
    p = P._prompts(spark, sf).select(F.concat(F.lit("P"), F.col("prompt_id").cast("string"), F.lit(".txt")).alias("name"), "prompt")
    files = SK.write_text_files(p, scratch_path(spark, "prompt-files"), "name", "prompt")
    out = ORG.write_templates(spark, fx.template_mts(spark), files, scratch_path(spark, "enriched"), name_partition="name")
    return out.select("prompt_id", "prompt", "msg_system_template", "trait_4")


@register("eval_saved", WF("select essay_id, prompt_id, score, score_map, score_pred from p", "completions", ctes=K._e2_scored_ctes()))
def q_eval_saved(spark, sf):
    path = scratch_path(spark, "scored")
    E.eval_mts_numeric(spark, fx.completions(spark, sf), save_to=path)
    return spark.read.parquet(path).select("essay_id", "prompt_id", "score", "score_map", "score_pred")
