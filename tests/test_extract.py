"""Score extraction against golden strings and against Python ``re`` on generated text."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark import config as C
from quillspark.operators import traits as TR


def py_trait(msg, pattern=C.TRAIT_SCORE_PATTERN):
    m = re.search(pattern, str(msg)) if msg is not None else None
    if m is None:
        return None
    v = float(re.search(r"\d+\.?\d*", m.group(0)).group(0))
    return v if 0 <= v <= 10 else None


def run(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, completion string")
    out = fn(df).orderBy("i").collect()
    return [r[-1] for r in out]


G1 = [
    ("Score: 7.", 7.0), ("I rate that 5 and Score: 8", 5.0), ("a score of 6.5/10", 6.5), ("8 out of 10", 8.0),
    ("Score: <score>9</score>", 9.0), ("Score: <score> 9</score>", None), ("score: 12", None),
    ("a score of 3/4 and 2 out of 5", 3.0), ("as a 4.25.", 4.25), ("Score of 5", None), ("Score:7", None),
    ("none", None), ("", None), (None, None),
]


def test_trait_golden(spark):
    got = run(spark, [s for s, _ in G1], lambda d: TR.with_trait_score(d).select("i", "trait_score"))
    assert got == [e for _, e in G1]


def test_trait_alt_golden(spark):
    got = run(spark, ["Score: <7>8</score>"], lambda d: TR.with_trait_score(d, pattern=C.TRAIT_SCORE_PATTERN_ALT))
    assert got == [7.0]


def test_fraction_golden(spark):
    rows = [("6 out of 12", 7), ("Score: 4/0", None), ("Score: 4.9", 4), ("<score>11</score>", 11), ("Score: 1", None),
            ("no answer", None), (None, None)]
    df = spark.createDataFrame([(i, 1, s) for i, (s, _) in enumerate(rows)], "i int, prompt_id int, msg_assistant string")
    out = TR.with_fraction_score(df, spark).orderBy("i").select("score_pred").collect()
    assert [r[0] for r in out] == [e for _, e in rows]


def test_category_golden(spark):
    rows = [('Score: "High"', "high"), ("rated as medium", "medium"), ("a Low score", "low"), ("it was high overall", "high"),
            ("unclear", None), ("Score:\n low", "low"), (None, None)]
    got = run(spark, [s for s, _ in rows], lambda d: TR.with_category(d, src="completion"))
    assert got == [e for _, e in rows]


TOKENS = ["Score: ", "score: ", "score of ", " out of ", "as a ", "at ", "<score>", "</score>", "/", ".", " ", "x", "\n",
          "Score:", "7", "10", "3.5", "12", "0", "99", "4.", "1"]


@settings(max_examples=1, deadline=None)
@given(st.lists(st.lists(st.sampled_from(TOKENS), min_size=0, max_size=12).map("".join), min_size=150, max_size=150))
def test_trait_matches_python_re(spark, texts):
    got = run(spark, texts, lambda d: TR.with_trait_score(d).select("i", "trait_score"))
    assert got == [py_trait(t) for t in texts]


def py_fraction(msg, lo, hi):
    """Overall-score semantics written out with Python ``re`` (brute-force reference)."""
    if msg is None:
        return None
    m = re.search(C.FRACTION_PATTERN, msg)
    if m:
        nums = [float(x) for x in m.groups() if x is not None and re.match(r"\d+", x)]
        if nums[1] == 0:
            return None
        pred = int(round(nums[0] / nums[1] * (hi - lo) + lo))
        return pred if lo <= pred <= hi else None
    m = re.search(C.ABSOLUTE_PATTERN, msg)
    if m:
        pred = int(round(float(re.search(r"\d+", m.group(0)).group(0))))
        return pred if lo <= pred <= hi else None
    return None


def py_category(msg):
    m = re.search(C.CATEGORY_PATTERN, msg) if msg is not None else None
    return None if m is None else re.search(C.CATEGORY_WORD_PATTERN, m.group(0)).group(0).lower()


FRACTION_TOKENS = ["Score:", "\n", " ", "7", "10", "3", "0", "12", "/", " out of ", "a score of ", ".", "5",
                   "<score>", "</score>", "x", "2.5", "60"]
CATEGORY_TOKENS = ["Score:", "score of", "as", "has", " ", "\n", '"', "low", "Low", "medium", "Medium", "high", "HIGH",
                   "High", " score", "x"]


@settings(max_examples=1, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 8), st.lists(st.sampled_from(FRACTION_TOKENS), max_size=10).map("".join)),
                min_size=200, max_size=200))
def test_fraction_matches_python_re(spark, cases):
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(cases)], "i int, prompt_id int, msg_assistant string")
    got = [r[0] for r in TR.with_fraction_score(df, spark).orderBy("i").select("score_pred").collect()]
    assert got == [py_fraction(t, *C.ASAP_SCORE_RANGES[p]) for p, t in cases]


@settings(max_examples=1, deadline=None)
@given(st.lists(st.lists(st.sampled_from(CATEGORY_TOKENS), max_size=8).map("".join), min_size=200, max_size=200))
def test_category_matches_python_re(spark, texts):
    got = run(spark, texts, lambda d: TR.with_category(d, src="completion"))
    assert got == [py_category(t) for t in texts]
