"""Prompts without a range, null prompts, repeated ids, Unicode digits and spaces, wide tables, shipping, scratch."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from conftest import ROOT, SF_SMALL
from quillspark import config as C
from quillspark import session
from quillspark.functions import text as TX
from quillspark.operators import compose as CO
from quillspark.operators import dataset as DS
from quillspark.operators import infer as INF
from quillspark.operators import metrics as M
from quillspark.operators import sampling as SM
from quillspark.operators import scaling as S
from quillspark.operators import traits as T
from quillspark.operators.quantiles import exact_quantiles
from quillspark.sources import fixtures as fx
from quillspark.sources.tables import with_range


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_no_row_is_lost_by_prompt(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 8.0), (9, 1.0), (9, 7.0), (None, 5.0), (77, 3.0)], "prompt_id int, score_agg double")
    listed = C.ScoreDomain(ranges={1: (0, 3), 9: (0, 5)})
    got = rows(S.map_minmax(df, spark, listed, clip=False).select("prompt_id", "score_map"))
    assert got == sorted([(1, 0.0), (1, 3.0), (9, 0.0), (9, 5.0), (None, None), (77, None)], key=str)
    assert S.map_minmax(df, spark, C.TOEFL).count() == 6 and S.map_standard(df, spark, C.TOEFL).count() == 6
    assert rows(with_range(df, spark, C.TOEFL).select("prompt_id", "s_min", "s_max").distinct()) == sorted(
        [(1, 1, 5), (9, 1, 5), (77, 1, 5), (None, None, None)], key=str)
    both = C.ScoreDomain(ranges={1: (0, 3)}, default=(1, 5))
    assert {r["prompt_id"]: r["s_max"] for r in with_range(df, spark, both).collect()} == {1: 3, 9: 5, 77: 5, None: None}


def test_null_prompts_are_no_group(spark):
    df = spark.createDataFrame([(1, "low", "low"), (1, "high", "high"), (None, "low", "high")], "prompt_id int, a string, b string")
    report = {r["prompt_id"]: r["qwk"] for r in M.macro_report(M.qwk(df, spark, "a", "b", C.TOEFL)).collect()}
    assert report == {"1": 1.0, "average": 1.0}
    # a row without a prompt is in no prompt's line, but it is a row of the table
    assert rows(M.dropped_report(df, "b")) == [("1", 2, 2, 0), ("all", 3, 3, 0), ("none", 1, 1, 0)]
    assert rows(T.coverage(df, "b")) == [(1, 2, 2, 0)]


def test_counted_rows_give_the_same_statistics(spark):
    rng = [(1 + i % 2, float((i * 7919) % 23) / 2, float(i % 7), float(i % 5), float(i % 3), float(i % 11)) for i in range(3000)]
    df = spark.createDataFrame(rng, "prompt_id int, v double, trait1 double, trait2 double, trait3 double, trait4 double")
    cells = df.groupBy("prompt_id", "v").agg(F.count("*").alias("c"))
    a = rows(exact_quantiles(df, "prompt_id", "v", [0.25, 0.75], with_min_max=True))
    assert a == rows(exact_quantiles(cells, "prompt_id", "v", [0.25, 0.75], with_min_max=True, count="c"))
    traits = df.groupBy("prompt_id", "trait1", "trait2", "trait3", "trait4").agg(F.count("*").alias("c"))
    x, y = rows(T.trait_std_weights(df)), rows(T.trait_std_weights(traits, count="c"))
    assert all(abs(p - q) < 1e-9 for r, s in zip(x, y) for p, q in zip(r, s))


def test_repeated_ids_are_sampled_once(spark):
    ids = list(range(11)) + [3] * 29
    df = spark.createDataFrame([(i, 1, f"t{k}") for k, i in enumerate(ids)], "essay_id long, prompt_id int, essay string")
    sample = [r["essay_id"] for r in SM.sample_fraction(df, 0.25).collect()]
    assert len(sample) == 3 == len(set(sample))
    got = [r["essay_id"] for r in SM.sample_rows(df, 0.25).collect()]
    assert sorted(got) == sorted(i for i in ids if i in sample)


def test_distinct_keeps_the_least_row(spark):
    df = spark.createDataFrame([(1, 5), (1, 2), (2, 9)], "essay_id int, prompt_id int").repartition(3)
    assert rows(DS.distinct_by(df)) == [(1, 2), (2, 9)]


def test_unicode_digits_and_separators(spark):
    df = spark.createDataFrame([("Score: \u0663",), ("score of \u096a.5",), ("Score: 3",)], "completion string")
    assert [r[0] for r in T.with_trait_score(df).select("trait_score").collect()] == [3.0, 4.5, 3.0]
    f = spark.createDataFrame([(3, "Score: \u0661/\u0662"), (3, "Score: \u0662")], "prompt_id int, msg_assistant string")
    assert [r[0] for r in T.with_fraction_score(f, spark).select("score_pred").collect()] == [2, 2]
    import re

    texts = [f"a...{s}...b ??{s}??c !!{s}{s}!!" for s in C.PY_WHITESPACE] + ["a...\u200b...b"]
    t = spark.createDataFrame([(x,) for x in texts], "t string")
    want = []
    for x in texts:
        for pattern, by in ((C.ELLIPSIS_PATTERN, "..."), (C.QUESTION_PATTERN, "?"), (C.EXCLAIM_PATTERN, "!")):
            x = re.sub(pattern, by, x)
        want.append(x)
    assert [r[0] for r in t.select(TX.collapse_punct("t")).collect()] == want


def test_wide_and_back_is_the_identity(spark):
    long = fx.completions(spark, SF_SMALL).select("essay_id", "prompt_id", "trait_idx", "completion")
    back = CO.from_wide(CO.to_wide(long, ["essay_id", "prompt_id"], ["completion"]), ["completion"])
    assert back.select(*long.columns).exceptAll(long).count() == 0 and back.count() == long.count()


def test_completions_are_written_once_without_the_texts(spark):
    long = CO.compose_mts(fx.essays(spark, SF_SMALL).select("essay_id", "prompt_id", "essay", "score"), fx.template_mts(spark), frac=None)
    out = session.scratch_path(spark, "completions")
    done = INF.infer_two_turn(spark, long, out=out)
    assert done.columns == ["essay_id", "prompt_id", "score", "trait_idx", "msg_assistant_retrieval", "msg_assistant_score"]
    size = sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(out.removeprefix("file:")) for f in names)
    assert size < 100_000  # 800 rows of keys and short replies; the prompts hold 1.3 million characters


def test_inference_from_another_folder(tmp_path):
    code = (f"import sys; sys.path.insert(0, {ROOT!r})\nimport __spark_entry__ as E\nfrom quillspark.session import local_session\n"
            f"print('rows', E.queries()['infer_vanilla'](local_session(2), {SF_SMALL!r}).count())")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows " in done.stdout, done.stderr[-2000:]


def test_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(Conf)

    class Session:
        sparkContext = Context

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_root(Session)
