"""The scoring workflow end to end, as Spark jobs with written tables between the steps.

1. organize : raw corpus -> canonical dataset ``(essay_id, prompt_id, essay, score)``
2. compose  : dataset x templates -> sampled test set with per-trait messages (long form)
3. infer    : model completions (written out: model output is not repeatable)
4. evaluate : extraction -> aggregation -> scaling -> kappa report (scored table saved to a new path)

Each step reads what the previous one wrote, so a failed step is rerun alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .. import config as C
from ..operators import compose as CO
from ..operators import infer as INF
from . import evaluate as E


@dataclass
class Paths:
    dataset: str
    test_set: str
    completions: str
    scored: str


def compose_step(spark: SparkSession, dataset: DataFrame, templates: DataFrame, out: str, method: str = "mts",
                 frac: float | None = C.SAMPLE_FRACTION, seed: int = C.SAMPLE_SEED) -> DataFrame:
    """Write the composed test set (partitioned by prompt) and return it as read back."""
    if method == "mts":
        test = CO.compose_mts(dataset, templates, frac, seed)
    else:
        test = CO.compose_vanilla(dataset, templates, frac, seed)
    test.write.mode("errorifexists").partitionBy("prompt_id").parquet(out)
    return spark.read.parquet(out)


def infer_step(spark: SparkSession, test_set: DataFrame, out: str, method: str = "mts",
               make_predict_fn=INF.length_stub_model, batch_size: int = 8, num_partitions: int | None = None) -> DataFrame:
    """Completions for every test row, written to ``out``."""
    if method == "mts":
        done = INF.infer_two_turn(spark, test_set, make_predict_fn, batch_size, num_partitions=num_partitions, out=out)
        return done.withColumnRenamed("msg_assistant_score", "completion")
    return INF.infer_vanilla(spark, test_set, make_predict_fn, batch_size, num_partitions=num_partitions, out=out)


def evaluate_step(spark: SparkSession, completions: DataFrame, scored_out: str, method: str = "mts",
                  domain: C.ScoreDomain = C.ASAP, **kw) -> DataFrame:
    """Kappa report; the scored table is written to ``scored_out``."""
    ordinal = domain.labels is not None
    if method == "mts":
        fn = E.eval_mts_ordinal if ordinal else E.eval_mts_numeric
    else:
        fn = E.eval_vanilla_ordinal if ordinal else E.eval_vanilla_numeric
    return fn(spark, completions, domain, save_to=scored_out, **kw)


def run(spark: SparkSession, dataset: DataFrame, templates: DataFrame, paths: Paths, method: str = "mts",
        domain: C.ScoreDomain = C.ASAP, make_predict_fn=INF.length_stub_model, frac: float | None = C.SAMPLE_FRACTION,
        seed: int = C.SAMPLE_SEED, batch_size: int = 8) -> DataFrame:
    """Dataset + templates -> report, writing the test set, completions and scores on the way."""
    dataset.write.mode("errorifexists").parquet(paths.dataset)
    ds = spark.read.parquet(paths.dataset)
    test = compose_step(spark, ds, templates, paths.test_set, method, frac, seed)
    comp = infer_step(spark, test, paths.completions, method, make_predict_fn, batch_size)
    return evaluate_step(spark, comp, paths.scored, method, domain)
