"""The file-to-report workflow runs end to end and its report equals the in-memory evaluation."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from quillspark.operators import compose as CO
from quillspark.operators import infer as INF
from quillspark.plans import evaluate as E
from quillspark.plans import workflow as W
from quillspark.session import scratch_path
from quillspark.sources import files as FL
from quillspark.sources import fixtures as fx
from quillspark.sources import sinks as SK


def test_workflow_mts(spark):
    ds = fx.essays(spark, SF_SMALL).select("essay_id", "prompt_id", "essay", "score")
    tpl_path = SK.write_delimited(fx.template_mts(spark), scratch_path(spark, "tpl"), header=True)
    templates = FL.read_templates(spark, tpl_path, "mts")
    assert sorted(templates.collect()) == sorted(fx.template_mts(spark).collect())
    paths = W.Paths(*(scratch_path(spark, n) for n in ("ds", "test", "comp", "scored")))
    report = {r["prompt_id"]: r["qwk"] for r in W.run(spark, ds, templates, paths, frac=0.5).collect()}
    assert "average" in report
    # same result without the intermediate tables
    long = INF.infer_two_turn(spark, CO.compose_mts(ds, templates, 0.5), keep_output=False)
    direct = {r["prompt_id"]: r["qwk"] for r in E.eval_mts_numeric(spark, long.withColumnRenamed("msg_assistant_score", "completion")).collect()}
    assert report == direct
    assert spark.read.parquet(paths.scored).where(F.col("score_pred").isNotNull()).count() > 0
