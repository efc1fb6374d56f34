"""Queries on the parts of a run that files and models make hard: file order, empty files, encodings, spreadsheets, broken
inference, sampling models, rejected rows, agreement of real numbers. Same contract as ``catalog``."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..operators import compose as CO
from ..operators import dataset as DS
from ..operators import infer as INF
from ..operators import metrics as M
from ..session import scratch_path
from ..sources import files as FL
from ..sources import fixtures as fx
from ..sources import sinks as SK
from ..sources import spreadsheets as XL
from ..sources.tables import read_table
from . import catalog as K
from . import catalog_prep as P
from . import evaluate as E
from . import oracle as O
from . import organize as ORG
from .registry import register
from .rejects import reject_report

WF = O.with_fixtures

# ------------------------------------------------------------------ one file per essay, flat folder

EMPTY_EVERY = 50  # every 50th essay file has no bytes


@register("src_wholetext_flat", WF(
    f"select i.path, case when e.essay_id % {EMPTY_EVERY} = 0 then '' else {O.py_strip_sql('e.essay')} end as essay, e.prompt_id, i.proficiency_level "
    "from (select 'essay ' || path as path, proficiency_level from index_rows) i join essays e on i.path = 'essay ' || cast(e.essay_id as varchar) || '.txt'",
    "index_rows", "essays"))
def q_src_wholetext_flat(spark, sf):
    """One flat folder of essay files, names with spaces, some without a byte, read by their index."""
    name = F.concat(F.lit("essay "), F.col("essay_id").cast("string"), F.lit(".txt")).alias("path")
    essay = F.when(F.col("essay_id") % EMPTY_EVERY == 0, F.lit("")).otherwise(F.col("essay")).alias("essay")
    text_dir = SK.write_flat_text_files(fx.essays(spark, sf).select(name, essay), scratch_path(spark, "essay-folder"), "path", "essay")
    index = fx.index_rows(spark, sf).withColumn("path", F.concat(F.lit("essay "), F.col("path")))
    d = ORG.organize_proficiency_corpus(spark, SK.write_delimited(index, scratch_path(spark, "index-csv")), text_dir)
    return d.select("path", "essay", "prompt_id", "proficiency_level")


# ------------------------------------------------------------------ another encoding, split by lines

LATIN = (r"[^\x00-\xFF]", r"[\r\n]")


@register("src_rated_latin1", WF(
    r"select * replace (regexp_replace(regexp_replace(essay, '[^\x{0}-\x{FF}]', '?', 'g'), '[\r\n]', ' ', 'g') as essay) from raw_ratings", "raw_ratings"))
def q_src_rated_latin1(spark, sf):
    """The rated corpus as ISO-8859-1, one line a row, split over tasks."""
    essay = F.regexp_replace(F.regexp_replace("essay", LATIN[0], "?"), LATIN[1], " ")
    rows = fx.raw_ratings(spark, sf).withColumn("essay", essay)
    path = SK.write_delimited(rows, scratch_path(spark, "rated-latin1"), sep="\t", header=True, encoding="ISO-8859-1")
    return FL.read_rated_corpus(spark, path, encoding="ISO-8859-1")


# ------------------------------------------------------------------ spreadsheets


@register("src_xlsx", WF("select * replace (case when essay_id % 7 <> 0 then essay end as essay, nullif(domain1_score, 2) as domain1_score) from raw_ratings", "raw_ratings"))
def q_src_xlsx(spark, sf):
    """The rated corpus written as workbooks and read back: nulls, numbers, line breaks."""
    rows = fx.raw_ratings(spark, sf).withColumn("essay", F.when(F.col("essay_id") % 7 != 0, F.col("essay")))
    rows = rows.withColumn("domain1_score", F.nullif(F.col("domain1_score"), F.lit(2.0)))
    return XL.read_xlsx(spark, XL.write_xlsx(rows, scratch_path(spark, "rated-xlsx")), FL.RATED_CORPUS_SCHEMA)


@register("src_templates_xlsx", WF(
    "select essay_id, prompt_id, score, prompt, msg_user_retrieval_template, trait_1, rubric_1 from essays join template_mts using (prompt_id)",
    "essays", "template_mts"))
def q_src_templates_xlsx(spark, sf):
    """A dataset and a template workbook, written, read back and joined."""
    data = XL.write_xlsx(fx.essays(spark, sf).select("essay_id", "prompt_id", "score"), scratch_path(spark, "dataset-xlsx"))
    schema = T.StructType([T.StructField("essay_id", T.LongType()), T.StructField("prompt_id", T.IntegerType()), T.StructField("score", T.IntegerType())])
    templates = FL.read_templates(spark, XL.write_xlsx(fx.template_mts(spark), scratch_path(spark, "templates-xlsx")), "mts", fmt="xlsx")
    d = CO.join_template(XL.read_xlsx(spark, data, schema), templates)
    return d.select("essay_id", "prompt_id", "score", "prompt", "msg_user_retrieval_template", "trait_1", "rubric_1")


# ------------------------------------------------------------------ rows in file order, ids repeated

ORDERED = ("select path, prompt_id, case when k = 0 then proficiency_level else 'repeated' end as proficiency_level, "
           "md5(path || ':' || cast(k as varchar)) as place from index_rows, (values (0), (1), (2)) t(k) where k = 0 or length(path) % 3 = k")


def _unsorted_index(spark, sf) -> str:
    """An index of several files whose rows stand in an order of no column; some paths come twice."""
    rows = fx.index_rows(spark, sf).select("*", F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("k")).where("k = 0 or length(path) % 3 = k")
    rows = rows.withColumn("proficiency_level", F.when(F.col("k") == 0, F.col("proficiency_level")).otherwise("repeated"))
    place = F.md5(F.concat_ws(":", "path", F.col("k").cast("string")).cast("binary"))
    rows = rows.withColumn("place", place).repartitionByRange(5, "place").sortWithinPartitions("place")
    return SK.write_delimited(rows.select("path", "prompt_id", "proficiency_level"), scratch_path(spark, "unsorted-index"))


@register("dense_row_id_file_order", WF(
    "select path, proficiency_level, cast(row_number() over (order by place) - 1 as bigint) as essay_id from ordered", "index_rows", ctes={"ordered": ORDERED}))
def q_dense_row_id_file_order(spark, sf):
    index = FL.read_index(spark, _unsorted_index(spark, sf), order="file_order")
    return DS.dense_index(spark, index, "file_order", "essay_id").select("path", "proficiency_level", "essay_id")


@register("distinct_first", WF(
    "select path, arg_min(proficiency_level, place) as proficiency_level from ordered group by path", "index_rows", ctes={"ordered": ORDERED}))
def q_distinct_first(spark, sf):
    index = FL.read_index(spark, _unsorted_index(spark, sf), order="file_order")
    return DS.distinct_by(index, "path", ("proficiency_level",), order="file_order")


# ------------------------------------------------------------------ tau-b of real numbers

REAL = "select lang as prompt_id, doc_id as essay_id, n_chars / (1.0 + doc_id % 7) as a, ((doc_id * 7919) % 10007) / 3.0 + n_chars as b from documents where n_chars is not null"


@register("kendall_tau_real", WF("select prompt_id, n, kendall_tau from kt", ctes={
    **K.KENDALL_BRUTE, "kp": REAL.replace("n_chars / (1.0 + doc_id % 7)", "cast(n_chars as double) / cast(1 + doc_id % 7 as double)").replace("/ 3.0", "/ cast(3 as double)")}))
def q_kendall_tau_real(spark, sf):
    """Two real-valued columns; the bound of the value grid is lowered, so that small tables go by blocks as well."""
    d = read_table(spark, sf, "documents").where("n_chars IS NOT NULL").selectExpr(
        "lang as prompt_id", "cast(n_chars as double) / cast(1 + doc_id % 7 as double) as a", "cast((doc_id * 7919) % 10007 as double) / 3D + n_chars as b")
    return M.tau_from_cells(M.contingency(d, "a", "b"), grid_values=20, block_cells=500)


# ------------------------------------------------------------------ rejected rows (F2, K6)

TEMPLATES_10 = "select p as prompt_id, case when p <> 3 then 'You are a rater.' end as msg_system, '@essay' as msg_user_instruction_template from range(1, 11) t(p)"


@register("reject_report", WF(
    "select reason, n_rows from (select r.reason, count(q.reason) as n_rows from (values ('no_prompt'), ('no_template'), ('null_template_cell'), ('no_range'), "
    "('no_prediction'), ('kept')) r(reason) left join (select case when p.prompt_id is null then 'no_prompt' when t.prompt_id is null then 'no_template' "
    "when t.msg_system is null then 'null_template_cell' when r.s_min is null then 'no_range' when p.score_pred is null then 'no_prediction' else 'kept' end as reason "
    "from p left join templates t using (prompt_id) left join score_range r on r.prompt_id = p.prompt_id) q using (reason) group by r.reason) "
    "union all select 'all', count(*) from p",
    "score_range", "vanilla_any", ctes={
        "templates": TEMPLATES_10, "v1": K._vanilla_scored_ctes()["v1"].replace("from vanilla v join", "from vanilla_any v left join"),
        "v2": K._vanilla_scored_ctes()["v2"], "p": K._vanilla_scored_ctes()["p"]}))
def q_reject_report(spark, sf):
    """Prompts 1..12 or none, templates of 1..10 (one with an empty cell), ranges of 1..8, replies without a score."""
    templates = spark.range(1, 11).selectExpr("cast(id as int) as prompt_id", "case when id <> 3 then 'You are a rater.' end as msg_system",
                                              "'@essay' as msg_user_instruction_template")
    return reject_report(spark, E.score_vanilla_numeric(spark, fx.vanilla_any(spark, sf)), templates)


# ------------------------------------------------------------------ broken runs and sampling models


@register("infer_resumed", WF(f"select essay_id, prompt_id, prompt, {O.stub_reply('prompt')} as msg_assistant from vr", "essays", P.TV, ctes=P.VAN_SAMPLED))
def q_infer_resumed(spark, sf):
    """Half of the parts are asked, as by a run that broke; a second run asks for the rest."""
    test, store = P._vanilla_composed(spark, sf, C.SAMPLE_FRACTION), scratch_path(spark, "replies")
    INF.infer_vanilla(spark, test, store=store, parts=4, only=range(2))
    return INF.infer_vanilla(spark, test, store=store, parts=4).select("essay_id", "prompt_id", "prompt", "msg_assistant")


@register("infer_two_turn_stored", WF(
    f"select essay_id, trait_idx, completion as msg_assistant_retrieval, {O.stub_reply('prompt_score')} as msg_assistant_score from r3",
    "essays", "template_mts", ctes=P.TWO_TURN_SAMPLED))
def q_infer_two_turn_stored(spark, sf):
    d = INF.infer_two_turn(spark, P._long(spark, sf, C.SAMPLE_FRACTION), store=scratch_path(spark, "replies"), parts=2)
    return d.select("essay_id", "trait_idx", "msg_assistant_retrieval", "msg_assistant_score")


@register("infer_seeded", WF(
    "select essay_id, 'Score: ' || cast(cast('0x' || substr(md5(cast(essay_id as varchar)), 1, 8) as bigint) % 11 as varchar) as completion from essays", "essays"))
def q_infer_seeded(spark, sf):
    """A sampling model that is given a seed from each row's key."""
    e = fx.essays(spark, sf).select("essay_id", "essay")
    done = INF.batch_infer(e, "essay", "completion", INF.sampling_stub_model, seed=INF.row_seed("essay_id"), by_length=True)
    return SK.materialize(spark, done.select("essay_id", "completion"), "seeded")
