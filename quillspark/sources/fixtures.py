"""Deterministic adapters from the driver's tables to the schemas the scoring pipeline expects.

Everything is derived from ``documents`` (and the configured score ranges), so the work grows with
the corpus. Column definitions are SQL expressions with the same text as the DuckDB oracle
(``quillspark.plans.oracle``); each adapter is built once per session and data directory (a
DataFrame is an immutable plan, so reusing it is safe and spares the driver re-analysis).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import ASAP, ScoreDomain
from .tables import read_table, score_range

def _memo(spark: SparkSession, key, build):
    """One frame per session and key, kept on the session itself, so that it goes with the session."""
    frames = spark.__dict__.setdefault("_quill_frames", {})
    if key not in frames:
        frames[key] = build()
    return frames[key]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus."""
    return _memo(spark, ("documents", sf_dir), lambda: read_table(spark, sf_dir, "documents"))


ESSAYS = [
    "doc_id as essay_id",
    "cast(1 + doc_id % 8 as int) as prompt_id",
    "text as essay",
    "lang as language",
    "n_chars",
]
ESSAYS_SCORED = [
    "essay_id", "prompt_id", "essay", "language", "n_chars",
    "cast(s_min + floor((n_chars % 11) * (s_max - s_min) / 10.0) as int) as score",
    "case when n_chars % 11 < 4 then 'low' when n_chars % 11 < 8 then 'medium' else 'high' end as proficiency_level",
]


def essays(spark: SparkSession, sf_dir: str, domain: ScoreDomain = ASAP) -> DataFrame:
    """``(essay_id, prompt_id, essay, language, n_chars, score, proficiency_level)``."""
    def build():
        from pyspark.sql import functions as F
        e = documents(spark, sf_dir).selectExpr(*ESSAYS)
        return e.join(F.broadcast(score_range(spark, domain)), "prompt_id").selectExpr(*ESSAYS_SCORED)
    return _memo(spark, ("essays", sf_dir, domain.key()), build)


X_TRAIT = ("cast(case when essay_id % 23 = 0 then 0 when essay_id % 29 = 0 then 10 "
           "else least(10, 4 + cast(floor((n_chars % 11) / 4) as int) + (essay_id * 7 + trait_idx * 5) % 3) end as string)")
COMPLETION = """case (essay_id * 3 + trait_idx) % 17
    when 0 then 'I cannot rate this essay.'
    when 1 then null
    when 2 then concat('Score: 1', x, ' / 10')
    else case (essay_id + trait_idx) % 6
      when 0 then concat('Overall Score: ', x, '.')
      when 1 then concat('I give a score of ', x, '/10.')
      when 2 then concat(x, ' out of 10')
      when 3 then concat('I rate it as a ', x, ' overall')
      when 4 then concat('placed at ', x, '.5 here')
      else concat('Score: <score>', x, '</score>') end
  end"""


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form: one synthetic scoring completion per ``(essay, trait)``."""
    def build():
        e = essays(spark, sf_dir).selectExpr("essay_id", "prompt_id", "score", "proficiency_level", "n_chars",
                                             "explode(sequence(1, 4)) as trait_idx")
        e = e.selectExpr("essay_id", "prompt_id", "score", "proficiency_level", "trait_idx", f"{X_TRAIT} as x")
        return e.selectExpr("essay_id", "prompt_id", "score", "proficiency_level", "trait_idx", f"{COMPLETION} as completion")
    return _memo(spark, ("completions", sf_dir), build)


MSG_ASSISTANT = """case essay_id % 9
    when 0 then concat('Score: ', x, '/10')
    when 1 then concat('It earns ', x, '.5 out of 10')
    when 2 then concat('a score of ', x, '/10')
    when 3 then concat('Score:', chr(10), chr(10), x)
    when 4 then concat('<score>', x, '</score>')
    when 5 then 'no answer'
    when 6 then 'Score: 4/0'
    when 7 then concat('Score: ', x, '.9')
    else concat('Score: ', x, ' and then ', x, ' out of 10') end"""
MSG_CATEGORY = """case essay_id % 7
    when 0 then 'Score: "High"'
    when 1 then 'rated as medium'
    when 2 then 'a Low score'
    when 3 then concat('Score:', chr(10), ' low')
    when 4 then 'it was high overall'
    when 5 then 'unclear'
    else 'a score of Medium' end"""


def vanilla(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One completion per essay: numeric ``msg_assistant`` and categorical ``msg_category``."""
    def build():
        e = essays(spark, sf_dir).selectExpr("essay_id", "prompt_id", "score", "proficiency_level",
                                             "cast(n_chars % 11 as string) as x")
        return e.selectExpr("essay_id", "prompt_id", "score", "proficiency_level",
                            f"{MSG_ASSISTANT} as msg_assistant", f"{MSG_CATEGORY} as msg_category")
    return _memo(spark, ("vanilla", sf_dir), build)


ESSAYS_ANY = [
    "doc_id as essay_id", "cast(nullif(1 + doc_id % 13, 13) as int) as prompt_id", "n_chars", "cast(n_chars % 5 as int) as score",
    "case when n_chars % 11 < 4 then 'low' when n_chars % 11 < 8 then 'medium' else 'high' end as proficiency_level",
]


def completions_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``completions``, for prompts 1..12 and rows without a prompt."""
    def build():
        e = documents(spark, sf_dir).selectExpr(*ESSAYS_ANY).selectExpr("*", "explode(sequence(1, 4)) as trait_idx")
        e = e.selectExpr("essay_id", "prompt_id", "score", "proficiency_level", "trait_idx", f"{X_TRAIT} as x")
        return e.selectExpr("essay_id", "prompt_id", "score", "proficiency_level", "trait_idx", f"{COMPLETION} as completion")
    return _memo(spark, ("completions_any", sf_dir), build)


def vanilla_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``vanilla``, for prompts 1..12 and rows without a prompt."""
    def build():
        e = documents(spark, sf_dir).selectExpr(*ESSAYS_ANY).selectExpr("*", "cast(n_chars % 11 as string) as x")
        return e.selectExpr("essay_id", "prompt_id", "score", "proficiency_level", f"{MSG_ASSISTANT} as msg_assistant")
    return _memo(spark, ("vanilla_any", sf_dir), build)


def long_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions inside long text: each document's text before and after a scoring phrase."""
    def build():
        e = essays(spark, sf_dir).selectExpr("*", "cast(n_chars % 11 as string) as x")
        return e.selectExpr("essay_id", "prompt_id", "concat(essay, ' I give a score of ', x, '/10. ', essay) as completion",
                            f"concat(essay, ' ', {MSG_ASSISTANT}, ' ', essay) as msg_assistant")
    return _memo(spark, ("long_completions", sf_dir), build)


DIRTY = ("concat('  ', text, ' @PERSON', cast(doc_id % 9 as string), ' @DATE12 wait... .... ok?? ??? !!! !! http://www.site', "
         "cast(doc_id as string), '.com.cn/a  ')")


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents wrapped in text that exercises every cleaning step."""
    return _memo(spark, ("dirty", sf_dir), lambda: documents(spark, sf_dir).selectExpr("doc_id", f"{DIRTY} as text"))


RAW_RATINGS = [
    "doc_id as essay_id", "cast(1 + doc_id % 8 as int) as essay_set", "text as essay",
    "cast(n_chars % 4 as double) as domain1_score",
    "cast((doc_id + 0) % 4 as double) as rater1_trait1", "cast((doc_id + 1) % 4 as double) as rater1_trait2",
    "cast((doc_id + 2) % 4 as double) as rater1_trait3", "cast((n_chars + 3) % 4 as double) as rater1_trait4",
    "cast((n_chars + 0) % 4 as double) as rater2_trait1", "cast((n_chars + 1) % 4 as double) as rater2_trait2",
    "cast((n_chars + 2) % 4 as double) as rater2_trait3", "cast((doc_id + 3) % 4 as double) as rater2_trait4",
]


def raw_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rated-corpus layout: essay_set, domain1_score and two raters' four trait scores."""
    return _memo(spark, ("raw_ratings", sf_dir), lambda: documents(spark, sf_dir).selectExpr(*RAW_RATINGS))


TEMPLATE_MTS = [
    "prompt_id", "concat('Prompt text ', cast(prompt_id as string)) as prompt",
    "'You judge @trait. @trait means: @description' as msg_system_template",
    "'[Prompt] @prompt [Essay] @essay [Task] quote on @trait' as msg_user_retrieval_template",
    "'Rate @trait with: @rubric' as msg_user_score_template",
    "'Ideas' as trait_1", "'Order' as trait_2", "'Style' as trait_3", "'Form' as trait_4",
    "'desc 1' as description_1", "'desc 2' as description_2", "'desc 3' as description_3", "'desc 4' as description_4",
    "'rubric $1' as rubric_1", "'rubric 2' as rubric_2", "'rubric 3' as rubric_3", "'rubric 4' as rubric_4",
]


def template_mts(spark: SparkSession, domain: ScoreDomain = ASAP) -> DataFrame:
    """Multi-trait template: one row per prompt with 4 traits, descriptions and rubrics."""
    return _memo(spark, ("template_mts", domain.key()), lambda: score_range(spark, domain).selectExpr(*TEMPLATE_MTS))


def template_vanilla(spark: SparkSession, domain: ScoreDomain = ASAP) -> DataFrame:
    return _memo(spark, ("template_vanilla", domain.key()), lambda: score_range(spark, domain).selectExpr(
        "prompt_id", "concat('Prompt text ', cast(prompt_id as string)) as prompt", "'You are a rater.' as msg_system",
        "'[Prompt] @prompt [Essay] @essay Give a score.' as msg_user_instruction_template"))


def index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proficiency-corpus index layout: ``(path, prompt_id 'P1'..'P8', proficiency_level)``."""
    return _memo(spark, ("index_rows", sf_dir), lambda: essays(spark, sf_dir).selectExpr(
        "concat(cast(essay_id as string), '.txt') as path", "concat('P', cast(prompt_id as string)) as prompt_id",
        "proficiency_level"))


def language_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proficiency-corpus language table: ``(Filename, Language, Split)``."""
    return _memo(spark, ("language_rows", sf_dir), lambda: read_table(spark, sf_dir, "documents").selectExpr(
        "concat(cast(doc_id as string), '.txt') as Filename", "lang as Language", "source as Split"))
