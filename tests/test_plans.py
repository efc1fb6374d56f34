"""Physical-plan checks: Python only at the model call, pruned scans, no prompt-only windows."""

import pytest

from conftest import SF_SMALL
from quillspark.plans.registry import load_all

QUERIES, _ = load_all()
#: These call the model; the last two are cut by the write of their completions.
MODEL = {"batch_infer", "infer_vanilla", "infer_two_turn", "infer_vanilla_chat", "infer_two_turn_chat", "infer_wide"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_outside_inference(spark, name):
    p = plan(QUERIES[name](spark, SF_SMALL))
    has_py = "ArrowEvalPython" in p or "BatchEvalPython" in p
    assert has_py == (name == "batch_infer"), name  # other inference is written and read back
    assert "RoundRobinPartitioning" not in p


def test_inference_runs_the_model_in_python(spark):
    from quillspark.operators import compose as CO
    from quillspark.operators import infer as INF
    from quillspark.sources import fixtures as fx

    long = CO.compose_mts(fx.essays(spark, SF_SMALL).select("essay_id", "prompt_id", "essay", "score"), fx.template_mts(spark), frac=None)
    p = plan(INF.infer_two_turn(spark, long, keep_output=False))
    assert p.count("ArrowEvalPython") == 2 and p.count("FileScan") == 1


def test_sampling_reads_the_text_once(spark):
    from quillspark.operators import compose as CO
    from quillspark.sources import fixtures as fx

    corpus = fx.essays(spark, SF_SMALL).select("essay_id", "prompt_id", "essay", "score")
    for d in (CO.compose_mts(corpus, fx.template_mts(spark)), CO.compose_vanilla(corpus, fx.template_vanilla(spark))):
        scans = [line for line in plan(d).splitlines() if "FileScan parquet" in line and "text" in line.split("ReadSchema:")[1]]
        assert len(scans) == 1


def test_report_writes_no_essay_sized_table(spark, monkeypatch):
    from quillspark.sources import sinks as SK

    written = []
    monkeypatch.setattr(SK, "materialize", lambda s, df, name, f=SK.materialize: written.append((name, f(s, df, name))) or written[-1][1])
    QUERIES["eval_mts_numeric"](spark, "/root/testdata/sf0.01").collect()
    assert [n for n, _ in written] == ["cells"] and written[0][1].count() < 400


def test_flagship_plan(spark):
    from quillspark.plans import evaluate as E
    from quillspark.sources import fixtures as fx

    p = plan(E.score_mts_numeric(spark, fx.completions(spark, SF_SMALL), materialize=False))
    # windows only over histogram buckets or small aggregated tables, never prompt-wide over essays
    assert _prompt_only_windows_over_raw_rows(p) == []
    assert "percentile(" not in p  # exact quartiles come from the bucketed histogram
    scan = [line for line in p.splitlines() if "FileScan parquet" in line][0]
    assert "text" not in scan.split("ReadSchema:")[1]  # essay text is pruned at the scan


def _prompt_only_windows_over_raw_rows(p: str):
    """Window operators partitioned by prompt_id alone whose input is not an aggregate."""
    lines = p.splitlines()
    bad = []
    for i, line in enumerate(lines):
        s = line.strip().lstrip(":+- ").lstrip("*(0123456789) ")
        if not s.startswith("Window ["):
            continue
        parts = s.split("], [")
        if len(parts) < 2 or not parts[1].startswith("prompt_id#") or "," in parts[1].split("]")[0]:
            continue
        depth = len(line) - len(line.lstrip(" :+-|"))
        for below in lines[i + 1:]:
            if "HashAggregate" in below:
                break
            if "Scan" in below:
                bad.append(s[:120])
                break
    return bad


@pytest.mark.parametrize("name", sorted(set(QUERIES) - MODEL))
def test_no_window_by_prompt_over_rows(spark, name):
    assert _prompt_only_windows_over_raw_rows(plan(QUERIES[name](spark, SF_SMALL))) == []


def test_results_invariant_under_repartition(spark):
    from quillspark.plans import evaluate as E
    from quillspark.sources import fixtures as fx

    comp = fx.completions(spark, SF_SMALL)
    a = sorted(E.eval_mts_numeric(spark, comp).collect())
    b = sorted(E.eval_mts_numeric(spark, comp.repartition(13, "trait_idx")).collect())
    c = sorted(E.eval_mts_ordinal(spark, comp.repartition(3), agg_mode="std_wsum").collect())
    d = sorted(E.eval_mts_ordinal(spark, comp.coalesce(1), agg_mode="std_wsum").collect())
    assert a == b and c == d


def test_window_check_detects_prompt_windows(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    from quillspark.sources import fixtures as fx

    raw = fx.essays(spark, SF_SMALL).withColumn("r", F.row_number().over(Window.partitionBy("prompt_id").orderBy("essay_id")))
    assert _prompt_only_windows_over_raw_rows(plan(raw)) != []
