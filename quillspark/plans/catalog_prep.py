"""Preparation-side queries: sources and sinks, cleaning, dataset building, sampling, prompt
composition, chat rendering and inference. Same contract as ``catalog``."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..functions import templates as TP
from ..functions import text as TX
from ..operators import compose as CO
from ..operators import dataset as DS
from ..operators import infer as INF
from ..operators import metrics as M
from ..operators import sampling as SM
from ..session import scratch_path
from ..sources import files as FL
from ..sources import fixtures as fx
from ..sources import sinks as SK
from . import oracle as O
from .registry import register

WF = O.with_fixtures

# ------------------------------------------------------------------ cleaning


@register("clean_strip", WF(f"select doc_id, {O.py_strip_sql('text')} as text from dirty", "dirty"))
def q_clean_strip(spark, sf):
    return fx.dirty(spark, sf).select("doc_id", TX.py_strip("text").alias("text"))


@register("clean_entities", WF(f"select doc_id, {O.clean_entities('text')} as text from dirty", "dirty"))
def q_clean_entities(spark, sf):
    return fx.dirty(spark, sf).select("doc_id", TX.mask_entities("text").alias("text"))


@register("clean_urls", WF(f"select doc_id, {O.clean_urls('text')} as text from dirty", "dirty"))
def q_clean_urls(spark, sf):
    return fx.dirty(spark, sf).select("doc_id", TX.mask_urls("text").alias("text"))


@register("clean_punct", WF(f"select doc_id, {O.clean_punct('text')} as text from dirty", "dirty"))
def q_clean_punct(spark, sf):
    d = fx.dirty(spark, sf)
    for step in (TX.collapse_ellipses, TX.collapse_questions, TX.collapse_exclaims):
        d = d.withColumn("text", step("text"))
    return d.select("doc_id", "text")


@register("clean_corpus", WF(f"select doc_id, {O.clean_chain('text')} as text from dirty", "dirty"))
def q_clean_corpus(spark, sf):
    return TX.clean_text(fx.dirty(spark, sf), "text").select("doc_id", "text")


# ------------------------------------------------------------------ dataset

RESCORE_SQL = ("((((2 * rater1_trait1 + rater1_trait2) + rater1_trait3) + rater1_trait4) + "
               "(((2 * rater2_trait1 + rater2_trait2) + rater2_trait3) + rater2_trait4))")
OVERRIDE_SQL = "select * from (values " + ",".join(f"({k}, {v})" for k, v in C.ASAP_SCORE_OVERRIDES) + ") as o(essay_id, ov)"
SCORED_RAW = {
    "ovr": OVERRIDE_SQL,
    "rr": (f"select r.*, case when essay_set = {C.RESCORED_PROMPT} then {RESCORE_SQL} "
           f"else coalesce(cast(o.ov as double), r.domain1_score) end as new_score "
           f"from raw_ratings r left join ovr o using (essay_id)"),
}
CANONICAL_SQL = WF(
    f"select essay_id, essay_set as prompt_id, {O.clean_chain('essay')} as essay, cast(trunc(new_score) as int) as score from rr",
    "raw_ratings", ctes=SCORED_RAW)


@register("proj_canonical", CANONICAL_SQL)
def q_proj_canonical(spark, sf):
    return DS.organize_rated_corpus(spark, fx.raw_ratings(spark, sf))


@register("apply_overrides", WF(
    "select essay_id, coalesce(cast(o.ov as double), r.domain1_score) as domain1_score from raw_ratings r left join ovr o using (essay_id)",
    "raw_ratings", ctes={"ovr": OVERRIDE_SQL}))
def q_apply_overrides(spark, sf):
    return DS.apply_overrides(spark, fx.raw_ratings(spark, sf), C.ASAP_SCORE_OVERRIDES).select("essay_id", "domain1_score")


@register("weighted_rescore", WF(
    f"select essay_id, essay_set, case when essay_set = {C.RESCORED_PROMPT} then {RESCORE_SQL} else domain1_score end as domain1_score "
    "from raw_ratings", "raw_ratings"))
def q_weighted_rescore(spark, sf):
    return DS.weighted_rescore(fx.raw_ratings(spark, sf)).select("essay_id", "essay_set", "domain1_score")


@register("parse_prompt_id", WF(
    r"select path, try_cast(regexp_replace(prompt_id, 'P(\d)', '\1', 'g') as int) as prompt_id from index_rows", "index_rows"))
def q_parse_prompt_id(spark, sf):
    return fx.index_rows(spark, sf).select("path", DS.parse_prompt_id("prompt_id").alias("prompt_id"))


@register("dense_row_id", WF("select path, cast(row_number() over (order by path) - 1 as bigint) as essay_id from index_rows",
                             "index_rows"))
def q_dense_row_id(spark, sf):
    return DS.dense_index(spark, fx.index_rows(spark, sf).select("path"), "path", "essay_id")


PROMPTS_SQL = ("select cast(1 + item_id % 8 as int) as prompt_id, " + O.py_strip_sql("arg_min(text, item_id)")
               + " as prompt from benchmark group by 1")


def _prompts(spark, sf):
    from ..sources.tables import read_table
    b = read_table(spark, sf, "benchmark")
    return b.groupBy((F.lit(1) + F.col("item_id") % 8).cast("int").alias("prompt_id")).agg(
        TX.py_strip(F.min_by("text", "item_id")).alias("prompt"))


@register("attach_prompt", WF(
    "select t.prompt_id, p.prompt, t.msg_system, t.msg_user_instruction_template from template_vanilla t left join pr p using (prompt_id)",
    "template_vanilla", ctes={"pr": PROMPTS_SQL}))
def q_attach_prompt(spark, sf):
    return DS.attach_prompts(fx.template_vanilla(spark), _prompts(spark, sf)).select(
        "prompt_id", "prompt", "msg_system", "msg_user_instruction_template")


@register("lookup_range", WF("select essay_id, prompt_id, s_min, s_max from essays join score_range using (prompt_id)", "essays"))
def q_lookup_range(spark, sf):
    return DS.with_score_range(spark, fx.essays(spark, sf).select("essay_id", "prompt_id")).select(
        "essay_id", "prompt_id", "s_min", "s_max")


@register("join_template", WF(
    "select essay_id, prompt_id, score, prompt, msg_user_retrieval_template, trait_1, rubric_1 from essays join template_mts using (prompt_id)",
    "essays", "template_mts"))
def q_join_template(spark, sf):
    d = CO.join_template(fx.essays(spark, sf), fx.template_mts(spark))
    return d.select("essay_id", "prompt_id", "score", "prompt", "msg_user_retrieval_template", "trait_1", "rubric_1")


@register("join_metadata", "select d.doc_id, d.lang as language, d.n_chars, l.quality, l.toxic from documents d join labels l on d.doc_id = l.doc_id")
def q_join_metadata(spark, sf):
    from ..sources.tables import read_table
    d = read_table(spark, sf, "documents").select("doc_id", F.col("lang").alias("language"), "n_chars")
    lab = read_table(spark, sf, "labels").withColumnRenamed("doc_id", "label_doc_id")
    return DS.join_on(d, lab, "doc_id", "label_doc_id").select("doc_id", "language", "n_chars", "quality", "toxic")


@register("distinct_essays", WF("select distinct essay_id, prompt_id from completions", "completions"))
def q_distinct_essays(spark, sf):
    return DS.distinct_by(fx.completions(spark, sf), "essay_id", ("prompt_id",))


# ------------------------------------------------------------------ sampling

SAMPLED = {"smp": O.sample_rank("essays", C.SAMPLE_FRACTION, None, C.SAMPLE_SEED)}


def _sampled(spark, sf):
    e = fx.essays(spark, sf)
    return SM.sample_fraction(e.select("essay_id", "prompt_id"))


@register("sample_frac", WF("select essay_id, prompt_id from smp", "essays", ctes=SAMPLED))
def q_sample_frac(spark, sf):
    return _sampled(spark, sf)


@register("sample_n", WF(O.sample_rank("essays", None, C.SAMPLE_N, C.SAMPLE_SEED), "essays"))
def q_sample_n(spark, sf):
    return SM.sample_n(fx.essays(spark, sf).select("essay_id", "prompt_id"))


@register("semi_sampled", WF("select essay_id, prompt_id, score from essays where essay_id in (select essay_id from smp)",
                             "essays", ctes=SAMPLED))
def q_semi_sampled(spark, sf):
    e = fx.essays(spark, sf)
    return SM.keep_sampled(e, _sampled(spark, sf)).select("essay_id", "prompt_id", "score")


ZTEST_SQL = WF(
    "select pop.prompt_id, n_pop, n_sample, mean_pop, mean_sample, sd_pop, z, abs(z) > " + repr(C.Z_CRITICAL_05) + " as reject from "
    "(select prompt_id, count(score) as n_pop, avg(score) as mean_pop, stddev_pop(score) as sd_pop from essays group by prompt_id) pop "
    "join (select prompt_id, count(score) as n_sample, avg(score) as mean_sample from essays where essay_id in (select essay_id from smp) "
    "group by prompt_id) s using (prompt_id), "
    "lateral (select (mean_sample - mean_pop) / nullif(sd_pop / sqrt(n_sample), 0) as z) zz",
    "essays", ctes=SAMPLED)


@register("sample_ztest", ZTEST_SQL)
def q_sample_ztest(spark, sf):
    e = fx.essays(spark, sf).select("essay_id", "prompt_id", "score")
    return M.sample_ztest(e, SM.keep_sampled(e, _sampled(spark, sf)))


# ------------------------------------------------------------------ composition

TV = "template_vanilla"
INSTR_SQL = O.fill("msg_user_instruction_template", ("@prompt", O.py_strip_sql("prompt")), ("@essay", O.py_strip_sql("essay")))
TRAITS_SQL = " union all ".join(
    f"select prompt_id, prompt, msg_system_template, msg_user_retrieval_template, msg_user_score_template, "
    f"{k} as trait_idx, trait_{k} as trait, description_{k} as description, rubric_{k} as rubric from template_mts"
    for k in range(1, 5))
LONG_SQL = ("select e.essay_id, e.prompt_id, e.essay, e.score, t.trait_idx, t.trait, "
            + O.fill("msg_system_template", ("@trait", "trait"), ("@description", "description")) + " as msg_system, "
            + O.fill("msg_user_retrieval_template", ("@prompt", "prompt"), ("@essay", "essay"), ("@trait", "trait")) + " as msg_user_retrieval, "
            + O.fill("msg_user_score_template", ("@trait", "trait"), ("@rubric", "rubric")) + " as msg_user_score "
            "from {src} e join tr t using (prompt_id)")


def _long(spark, sf, frac=None):
    return CO.compose_mts(fx.essays(spark, sf).select("essay_id", "prompt_id", "essay", "score"), fx.template_mts(spark), frac=frac)


def _vanilla_composed(spark, sf, frac=None):
    return CO.compose_vanilla(fx.essays(spark, sf).select("essay_id", "prompt_id", "essay", "score"), fx.template_vanilla(spark), frac=frac)


@register("fill_instruction", WF(f"select essay_id, {INSTR_SQL} as msg_user_instruction from essays join {TV} using (prompt_id)",
                                 "essays", TV))
def q_fill_instruction(spark, sf):
    return _vanilla_composed(spark, sf).select("essay_id", "msg_user_instruction")


LONG_ALL = {"tr": TRAITS_SQL, "lg": LONG_SQL.format(src="essays")}


@register("fill_system", WF("select essay_id, trait_idx, msg_system from lg", "essays", "template_mts", ctes=LONG_ALL))
def q_fill_system(spark, sf):
    return _long(spark, sf).select("essay_id", "trait_idx", "msg_system")


@register("fill_retrieval", WF("select essay_id, trait_idx, msg_user_retrieval from lg", "essays", "template_mts", ctes=LONG_ALL))
def q_fill_retrieval(spark, sf):
    return _long(spark, sf).select("essay_id", "trait_idx", "msg_user_retrieval")


@register("fill_score", WF("select essay_id, trait_idx, msg_user_score from lg", "essays", "template_mts", ctes=LONG_ALL))
def q_fill_score(spark, sf):
    return _long(spark, sf).select("essay_id", "trait_idx", "msg_user_score")


@register("unpivot_traits", WF(
    "select e.essay_id, e.prompt_id, t.trait_idx, t.trait, t.description, t.rubric from essays e join tr t using (prompt_id)",
    "essays", "template_mts", ctes={"tr": TRAITS_SQL}))
def q_unpivot_traits(spark, sf):
    traits = CO.unpivot_traits(fx.template_mts(spark))
    e = fx.essays(spark, sf).select("essay_id", "prompt_id")
    return e.join(F.broadcast(traits), "prompt_id").select("essay_id", "prompt_id", "trait_idx", "trait", "description", "rubric")


PIVOT_COLS = ", ".join(f"max(case when trait_idx = {k} then {c} end) as {c}_{k}"
                       for c in ("msg_system", "msg_user_score") for k in range(1, 5))


@register("pivot_traits", WF(f"select essay_id, prompt_id, {PIVOT_COLS} from lg group by essay_id, prompt_id",
                             "essays", "template_mts", ctes=LONG_ALL))
def q_pivot_traits(spark, sf):
    return CO.to_wide(_long(spark, sf), ["essay_id", "prompt_id"], ["msg_system", "msg_user_score"])


@register("compose_vanilla", WF(
    f"select essay_id, prompt_id, score, {INSTR_SQL} as msg_user_instruction from essays join {TV} using (prompt_id) "
    "where essay_id in (select essay_id from smp)", "essays", TV, ctes=SAMPLED))
def q_compose_vanilla(spark, sf):
    return _vanilla_composed(spark, sf, C.SAMPLE_FRACTION).select("essay_id", "prompt_id", "score", "msg_user_instruction")


LONG_SAMPLED = {**SAMPLED, "tr": TRAITS_SQL, "es": "select * from essays where essay_id in (select essay_id from smp)",
                "lg": LONG_SQL.format(src="es")}


@register("compose_mts", WF("select essay_id, prompt_id, trait_idx, msg_system, msg_user_retrieval, msg_user_score from lg",
                            "essays", "template_mts", ctes=LONG_SAMPLED))
def q_compose_mts(spark, sf):
    return _long(spark, sf, C.SAMPLE_FRACTION).select(
        "essay_id", "prompt_id", "trait_idx", "msg_system", "msg_user_retrieval", "msg_user_score")


# ------------------------------------------------------------------ chat rendering

RENDER_SINGLE_SQL = O.fill(O.lit_template(C.SINGLE_TURN_TEMPLATE), ("@msg_system", "msg_system"), ("@msg_user_instruction", "ins"))
RENDER_RETR_SQL = O.fill(O.lit_template(C.RETRIEVAL_TEMPLATE), ("@msg_system", "msg_system"), ("@msg_user_retrieval", "msg_user_retrieval"))
RENDER_TWO_SQL = O.fill(O.lit_template(C.TWO_TURN_TEMPLATE), ("@msg_system", "msg_system"), ("@msg_user_retrieval", "msg_user_retrieval"),
                        ("@msg_assistant_retrieval", "completion"), ("@msg_user_score", "msg_user_score"))
VAN_ALL = {"vn": f"select essay_id, prompt_id, score, msg_system, {INSTR_SQL} as ins from essays join {TV} using (prompt_id)"}


@register("render_single", WF(f"select essay_id, {RENDER_SINGLE_SQL} as prompt from vn", "essays", TV, ctes=VAN_ALL))
def q_render_single(spark, sf):
    return _vanilla_composed(spark, sf).select("essay_id", TP.render_single().alias("prompt"))


@register("render_retrieval", WF(f"select essay_id, trait_idx, {RENDER_RETR_SQL} as prompt_retrieval from lg",
                                 "essays", "template_mts", ctes=LONG_ALL))
def q_render_retrieval(spark, sf):
    return _long(spark, sf).select("essay_id", "trait_idx", TP.render_retrieval().alias("prompt_retrieval"))


@register("render_two_turn", WF(
    f"select essay_id, trait_idx, {RENDER_TWO_SQL} as prompt_score from lg join completions c using (essay_id, trait_idx)",
    "essays", "template_mts", "completions", ctes=LONG_ALL))
def q_render_two_turn(spark, sf):
    replies = fx.completions(spark, sf).select("essay_id", "trait_idx", F.col("completion").alias("msg_assistant_retrieval"))
    d = _long(spark, sf).join(replies, ["essay_id", "trait_idx"])
    return d.select("essay_id", "trait_idx", TP.render_two_turn().alias("prompt_score"))


@register("messages_single", WF(
    "select essay_id, '<s>' || '[INST] ' || msg_system || chr(10) || ins || ' [/INST]' as prompt from vn", "essays", TV, ctes=VAN_ALL))
def q_messages_single(spark, sf):
    d = _vanilla_composed(spark, sf)
    return d.select("essay_id", TP.render_inst_chat(TP.messages_single()).alias("prompt"))


@register("messages_multi", "select conv_id, '<s>' || string_agg(case role when 'user' then '[INST] ' || text || ' [/INST]' "
          "when 'assistant' then text || '</s>' else text || chr(10) end, '' order by turn) as prompt from conversations group by conv_id")
def q_messages_multi(spark, sf):
    from ..operators.chat import conversation_prompts
    from ..sources.tables import read_table
    return conversation_prompts(read_table(spark, sf, "conversations"))


# ------------------------------------------------------------------ inference

@register("batch_infer", WF(f"select essay_id, {O.stub_reply('essay')} as completion from essays", "essays"))
def q_batch_infer(spark, sf):
    e = fx.essays(spark, sf).select("essay_id", "essay")
    return INF.batch_infer(e, "essay", "completion").select("essay_id", "completion")


VAN_SAMPLED = {**SAMPLED, "vn": f"select essay_id, prompt_id, score, msg_system, {INSTR_SQL} as ins from essays join {TV} using (prompt_id) "
                               "where essay_id in (select essay_id from smp)",
               "vr": f"select essay_id, prompt_id, {RENDER_SINGLE_SQL} as prompt from vn"}


@register("infer_vanilla", WF(f"select essay_id, prompt_id, prompt, {O.stub_reply('prompt')} as msg_assistant from vr",
                              "essays", TV, ctes=VAN_SAMPLED))
def q_infer_vanilla(spark, sf):
    d = INF.infer_vanilla(spark, _vanilla_composed(spark, sf, C.SAMPLE_FRACTION))
    return d.select("essay_id", "prompt_id", "prompt", "msg_assistant")


TWO_TURN_SAMPLED = {
    **LONG_SAMPLED,
    "r1": f"select lg.*, {RENDER_RETR_SQL} as prompt_retrieval from lg",
    "r2": f"select r1.*, {O.stub_reply('prompt_retrieval')} as completion from r1",
    "r3": f"select r2.*, {RENDER_TWO_SQL} as prompt_score from r2",
}


@register("infer_two_turn", WF(
    f"select essay_id, trait_idx, completion as msg_assistant_retrieval, {O.stub_reply('prompt_score')} as msg_assistant_score from r3",
    "essays", "template_mts", ctes=TWO_TURN_SAMPLED))
def q_infer_two_turn(spark, sf):
    d = INF.infer_two_turn(spark, _long(spark, sf, C.SAMPLE_FRACTION))
    return d.select("essay_id", "trait_idx", "msg_assistant_retrieval", "msg_assistant_score")


@register("union_groups", WF(
    "select 'mts' as method, essay_id, prompt_id, trait_idx, completion from completions union all "
    "select 'vanilla', essay_id, prompt_id, null, msg_assistant from vanilla", "completions", "vanilla"))
def q_union_groups(spark, sf):
    mts = fx.completions(spark, sf).select(F.lit("mts").alias("method"), "essay_id", "prompt_id", "trait_idx", "completion")
    van = fx.vanilla(spark, sf).select(F.lit("vanilla").alias("method"), "essay_id", "prompt_id",
                                       F.col("msg_assistant").alias("completion"))
    return INF.union_groups([mts, van]).select("method", "essay_id", "prompt_id", "trait_idx", "completion")


# ------------------------------------------------------------------ sources and sinks

@register("src_essays", WF("select * from raw_ratings", "raw_ratings"))
def q_src_essays(spark, sf):
    path = SK.write_delimited(fx.raw_ratings(spark, sf), scratch_path(spark, "rated-tsv"), sep="\t", header=True)
    return FL.read_rated_corpus(spark, path, multi_line=True)


@register("src_index_csv", WF("select * from index_rows", "index_rows"))
def q_src_index_csv(spark, sf):
    path = SK.write_delimited(fx.index_rows(spark, sf), scratch_path(spark, "index-csv"))
    return FL.read_index(spark, path)


@register("src_wholetext", WF(
    f"select i.path, {O.py_strip_sql('e.essay')} as essay, cast(regexp_replace(i.prompt_id, 'P(\\d)', '\\1', 'g') as int) as prompt_id, "
    "i.proficiency_level from index_rows i join essays e on i.path = cast(e.essay_id as varchar) || '.txt'", "index_rows", "essays"))
def q_src_wholetext(spark, sf):
    from ..plans.organize import organize_proficiency_corpus
    e = fx.essays(spark, sf).select(F.concat(F.col("essay_id").cast("string"), F.lit(".txt")).alias("path"), "essay")
    text_dir = SK.write_text_files(e, scratch_path(spark, "essay-files"), "path", "essay")
    index_path = SK.write_delimited(fx.index_rows(spark, sf), scratch_path(spark, "index-csv"))
    d = organize_proficiency_corpus(spark, index_path, text_dir, languages=None, name_partition="path")
    return d.select("path", "essay", "prompt_id", "proficiency_level")


@register("src_prompts", PROMPTS_SQL)
def q_src_prompts(spark, sf):
    p = _prompts(spark, sf).select(F.concat(F.lit("P"), F.col("prompt_id").cast("string"), F.lit(".txt")).alias("name"), "prompt")
    path = SK.write_text_files(p, scratch_path(spark, "prompt-files"), "name", "prompt")
    return FL.read_prompt_files(spark, path, name_partition="name")


@register("sink_roundtrip", CANONICAL_SQL)
def q_sink_roundtrip(spark, sf):
    d = DS.organize_rated_corpus(spark, fx.raw_ratings(spark, sf))
    path = SK.write_parquet(d, scratch_path(spark, "dataset"), partition_by="prompt_id")
    return spark.read.parquet(path).select("essay_id", "prompt_id", "essay", "score")
