"""DuckDB SQL for every registered query (the correctness oracle).

Tables ``documents``, ``labels``, ``conversations``, ``benchmark`` ... are views in DuckDB. The
fixture adapters are CTEs with the same definitions as ``quillspark.sources.fixtures``.
DuckDB regexes are RE2: no ``(?U)`` (it means "ungreedy" there).
"""

from __future__ import annotations

from .. import config as C

FIXTURES = {
    "score_range": (
        "select * from (values " + ",".join(f"({p},{lo},{hi})" for p, (lo, hi) in C.ASAP_SCORE_RANGES.items())
        + ") as t(prompt_id, s_min, s_max)"
    ),
    "toefl_range": (
        "select * from (values " + ",".join(f"({p},{C.TOEFL_SCORE_RANGE[0]},{C.TOEFL_SCORE_RANGE[1]})" for p in range(1, 9))
        + ") as t(prompt_id, s_min, s_max)"
    ),
    "essays": """
select d.doc_id as essay_id, cast(1 + d.doc_id % 8 as int) as prompt_id, d.text as essay, d.lang as language, d.n_chars,
  cast(r.s_min + floor((d.n_chars % 11) * (r.s_max - r.s_min) / 10.0) as int) as score,
  case when d.n_chars % 11 < 4 then 'low' when d.n_chars % 11 < 8 then 'medium' else 'high' end as proficiency_level
from documents d join score_range r on r.prompt_id = 1 + d.doc_id % 8""",
    "completions": """
select essay_id, prompt_id, score, proficiency_level, trait_idx,
  case (essay_id * 3 + trait_idx) % 17
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
  end as completion
from (
  select e.*, t.trait_idx,
    cast(case when essay_id % 23 = 0 then 0 when essay_id % 29 = 0 then 10
         else least(10, 4 + cast(floor((n_chars % 11) / 4) as int) + (essay_id * 7 + t.trait_idx * 5) % 3) end as string) as x
  from essays e cross join (values (1),(2),(3),(4)) as t(trait_idx)) q""",
    "vanilla": """
select essay_id, prompt_id, score, proficiency_level,
  case essay_id % 9
    when 0 then concat('Score: ', x, '/10')
    when 1 then concat('It earns ', x, '.5 out of 10')
    when 2 then concat('a score of ', x, '/10')
    when 3 then concat('Score:', chr(10), chr(10), x)
    when 4 then concat('<score>', x, '</score>')
    when 5 then 'no answer'
    when 6 then 'Score: 4/0'
    when 7 then concat('Score: ', x, '.9')
    else concat('Score: ', x, ' and then ', x, ' out of 10') end as msg_assistant,
  case essay_id % 7
    when 0 then 'Score: "High"'
    when 1 then 'rated as medium'
    when 2 then 'a Low score'
    when 3 then concat('Score:', chr(10), ' low')
    when 4 then 'it was high overall'
    when 5 then 'unclear'
    else 'a score of Medium' end as msg_category
from (select e.*, cast(n_chars % 11 as string) as x from essays e) q""",
    "dirty": """
select doc_id, concat('  ', text, ' @PERSON', cast(doc_id % 9 as string), ' @DATE12 wait... .... ok?? ??? !!! !! http://www.site',
  cast(doc_id as string), '.com.cn/a  ') as text
from documents""",
    "raw_ratings": """
select doc_id as essay_id, cast(1 + doc_id % 8 as int) as essay_set, text as essay, cast(n_chars % 4 as double) as domain1_score,
  cast((doc_id + 0) % 4 as double) as rater1_trait1, cast((doc_id + 1) % 4 as double) as rater1_trait2,
  cast((doc_id + 2) % 4 as double) as rater1_trait3, cast((n_chars + 3) % 4 as double) as rater1_trait4,
  cast((n_chars + 0) % 4 as double) as rater2_trait1, cast((n_chars + 1) % 4 as double) as rater2_trait2,
  cast((n_chars + 2) % 4 as double) as rater2_trait3, cast((doc_id + 3) % 4 as double) as rater2_trait4
from documents""",
    "template_mts": """
select prompt_id, concat('Prompt text ', cast(prompt_id as string)) as prompt,
  'You judge @trait. @trait means: @description' as msg_system_template,
  concat('[Prompt] @prompt [Essay] @essay [Task] quote on @trait') as msg_user_retrieval_template,
  'Rate @trait with: @rubric' as msg_user_score_template,
  'Ideas' as trait_1, 'Order' as trait_2, 'Style' as trait_3, 'Form' as trait_4,
  'desc 1' as description_1, 'desc 2' as description_2, 'desc 3' as description_3, 'desc 4' as description_4,
  'rubric $1' as rubric_1, 'rubric 2' as rubric_2, 'rubric 3' as rubric_3, 'rubric 4' as rubric_4
from score_range""",
    "template_vanilla": """
select prompt_id, concat('Prompt text ', cast(prompt_id as string)) as prompt, 'You are a rater.' as msg_system,
  '[Prompt] @prompt [Essay] @essay Give a score.' as msg_user_instruction_template
from score_range""",
    "index_rows": """
select concat(cast(essay_id as string), '.txt') as path, concat('P', cast(prompt_id as string)) as prompt_id, proficiency_level
from essays""",
}

FIXTURES["essays_any"] = """
select doc_id as essay_id, cast(nullif(1 + doc_id % 13, 13) as int) as prompt_id, n_chars, cast(n_chars % 5 as int) as score,
  case when n_chars % 11 < 4 then 'low' when n_chars % 11 < 8 then 'medium' else 'high' end as proficiency_level
from documents"""
FIXTURES["completions_any"] = FIXTURES["completions"].replace("from essays e", "from essays_any e")
FIXTURES["vanilla_any"] = FIXTURES["vanilla"].replace("from essays e", "from essays_any e")
FIXTURES["long_completions"] = """
select e.essay_id, e.prompt_id, concat(e.essay, ' I give a score of ', cast(e.n_chars % 11 as string), '/10. ', e.essay) as completion,
  concat(e.essay, ' ', v.msg_assistant, ' ', e.essay) as msg_assistant
from essays e join vanilla v using (essay_id)"""

DEPENDS = {
    "completions_any": ["essays_any"],
    "vanilla_any": ["essays_any"],
    "long_completions": ["essays", "vanilla"],
    "essays": ["score_range"],
    "completions": ["essays"],
    "vanilla": ["essays"],
    "template_mts": ["score_range"],
    "template_vanilla": ["score_range"],
    "index_rows": ["essays"],
}


def _order(names):
    out = []

    def visit(n):
        for d in DEPENDS.get(n, []):
            visit(d)
        if n not in out:
            out.append(n)

    for n in names:
        visit(n)
    return out


def with_fixtures(body: str, *names: str, ctes: dict | None = None) -> str:
    """Prefix ``body`` with the fixture CTEs it uses (and their dependencies), then extra CTEs."""
    parts = [f"{n} as ({FIXTURES[n]})" for n in _order(names)]
    parts += [f"{k} as ({v})" for k, v in (ctes or {}).items()]
    return ("with " + ",\n".join(parts) + "\n" + body) if parts else body


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# --- expression snippets -------------------------------------------------------------------

def first_number(col: str, pattern: str = C.TRAIT_SCORE_PATTERN) -> str:
    m = f"regexp_extract({col}, {sql_str(pattern)}, 0)"
    return f"try_cast(nullif(regexp_extract({m}, {sql_str(C.NUMBER_PATTERN)}, 0), '') as double)"


def in_range(v: str, lo, hi) -> str:
    return f"case when {v} >= {lo} and {v} <= {hi} then {v} end"


def category(col: str) -> str:
    m = f"regexp_extract({col}, {sql_str(C.CATEGORY_PATTERN)}, 0)"
    return f"nullif(lower(regexp_extract({m}, {sql_str(C.CATEGORY_WORD_PATTERN)}, 0)), '')"


def py_strip(col: str) -> str:
    chars = "".join(C.PY_WHITESPACE)
    return f"trim({col}, {sql_str(chars)})"


def bucket(x: str) -> str:
    lo, hi = C.LEVEL_EDGES
    a, b, c = C.LEVEL_LABELS
    return f"case when {x} < {lo} then '{a}' when {x} < {hi} then '{b}' when {x} is not null then '{c}' end"


def ordinal(x: str) -> str:
    arms = " ".join(f"when {x} = '{lab}' then {i}" for i, lab in enumerate(C.LEVEL_LABELS))
    return f"case {arms} end"


def qwk_from_pairs(pairs: str, group: str = "prompt_id") -> str:
    """SELECT over a relation ``pairs(group, a, b)`` giving ``(group, n, qwk)``."""
    d = "decimal(38,0)"
    return f"""
select {group}, n, round_even(1.0 - cast(n * sdd as double) / cast(nullif(n * saa + n * sbb - 2 * sa * sb, 0) as double), 3) as qwk
from (select {group}, count(*) as n, cast(sum(a) as {d}) as sa, cast(sum(b) as {d}) as sb,
        cast(sum(a * a) as {d}) as saa, cast(sum(b * b) as {d}) as sbb, cast(sum((a - b) * (a - b)) as {d}) as sdd
      from {pairs} group by {group}) s"""


def macro_report_sql(per_group: str, group: str = "prompt_id") -> str:
    return f"""
select cast({group} as varchar) as {group}, n, qwk from {per_group}
union all
select 'average', cast(sum(n) as bigint), case when count(qwk) = count(*) then round_even(avg(qwk), 3) end from {per_group}"""


def ws_chars() -> str:
    return " || ".join(f"chr({ord(c)})" for c in C.PY_WHITESPACE)


def py_strip_sql(col: str) -> str:
    return f"trim({col}, {ws_chars()})"


def clean_entities(col: str) -> str:
    pat = "@(" + "|".join(C.ENTITY_TAGS) + r")\d+"
    return f"regexp_replace({col}, {sql_str(pat)}, '{{\\1}}', 'g')"


def clean_urls(col: str) -> str:
    return f"regexp_replace({col}, {sql_str(C.URL_PATTERN)}, {sql_str(C.URL_REPLACEMENT)}, 'g')"


def clean_punct(col: str) -> str:
    e = f"regexp_replace({col}, {sql_str(C.ELLIPSIS_PATTERN)}, '...', 'g')"
    q = f"regexp_replace({e}, {sql_str(C.QUESTION_PATTERN)}, '?', 'g')"
    return f"regexp_replace({q}, {sql_str(C.EXCLAIM_PATTERN)}, '!', 'g')"


def clean_chain(col: str) -> str:
    return clean_punct(clean_urls(clean_entities(py_strip_sql(col))))


def fill(template: str, *pairs) -> str:
    out = template
    for ph, val in pairs:
        out = f"replace({out}, {sql_str(ph)}, {val})"
    return out


def lit_template(t: str) -> str:
    """A template literal with newlines written as chr(10)."""
    parts = t.split("\n")
    return " || chr(10) || ".join(sql_str(p) for p in parts)


def stub_reply(col: str) -> str:
    return f"case when {col} is not null then 'Score: ' || cast(length({col}) % 11 as varchar) end"


def sample_rank(src: str, frac: float | None, n: int | None, seed: int) -> str:
    k = f"round_even({frac} * count(*) over (partition by prompt_id), 0)" if frac is not None else str(n)
    return (f"select essay_id, prompt_id from (select essay_id, prompt_id, row_number() over (partition by prompt_id "
            f"order by md5('{seed}:' || cast(essay_id as varchar)), essay_id) as rn, {k} as k from {src}) q where rn <= k")
