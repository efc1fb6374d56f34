"""Why rows get no score: each row's first failing step, counted in one pass.

The steps are those of a scoring run: the row has a prompt, its prompt a template, no cell of the template is empty, the
prompt has a score range, the reply gave a prediction. The reason is a column of the row, so a task that runs again can't
count a row twice, as an accumulator (``DataFrame.observe``) might.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..sources.tables import broadcast_if_small, local_table, with_range

REASONS = ("no_prompt", "no_template", "null_template_cell", "no_range", "no_prediction")


def with_reject_reason(spark: SparkSession, scored: DataFrame, templates: DataFrame, domain: C.ScoreDomain = C.ASAP,
                       prediction: str = "score_pred", key: str = "prompt_id", out: str = "reject_reason") -> DataFrame:
    """``scored`` plus ``out``: the first reason that applies, null for rows with a prediction.

    ``templates`` has one row per prompt; any of its other columns may be the empty cell.
    """
    empty = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in templates.columns if c != key], F.lit(False))
    known = templates.where(F.col(key).isNotNull()).select(F.col(key).alias("__t_key"), empty.alias("__t_empty"))
    d = scored.join(broadcast_if_small(known), F.col(key) == F.col("__t_key"), "left")
    d = with_range(d.drop("s_min", "s_max"), spark, domain, key)
    reason = (
        F.when(F.col(key).isNull(), REASONS[0]).when(F.col("__t_key").isNull(), REASONS[1]).when(F.col("__t_empty"), REASONS[2])
        .when(F.col("s_min").isNull(), REASONS[3]).when(F.col(prediction).isNull(), REASONS[4])
    )
    return d.withColumn(out, reason).select(*scored.columns, out)


def reject_report(spark: SparkSession, scored: DataFrame, templates: DataFrame, domain: C.ScoreDomain = C.ASAP,
                  prediction: str = "score_pred", key: str = "prompt_id") -> DataFrame:
    """``(reason, n_rows)``: one row per reason, counts of 0 included, then ``kept`` and ``all`` (every row)."""
    marked = with_reject_reason(spark, scored.select(key, prediction), templates, domain, prediction, key)
    counts = marked.groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n_rows"))
    lines = local_table(spark, [(r,) for r in (*REASONS, "kept")], ["reason"])
    full = lines.join(counts, "reason", "left").select("reason", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))
    total = full.rollup("reason").agg(F.sum("n_rows").alias("n_rows"))
    return total.select(F.coalesce("reason", F.lit("all")).alias("reason"), "n_rows")
