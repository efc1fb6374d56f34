"""Incremental scoring of completions as inference writes them.

Inference runs for hours and lands its output as files. Instead of re-reading everything, a
Structured Streaming query reads new completion files, extracts trait scores (the same column
expressions as the batch path) and appends them to a scored table; each micro-batch is written
exactly once through the checkpointed file sink. Per-essay aggregation, scaling and the kappa
report stay batch jobs over the scored table: min-max scaling and quartiles need every essay of a
prompt, so they are computed when the run is complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import config as C
from ..operators import traits as TR

LONG_COMPLETION_SCHEMA = T.StructType([
    T.StructField("essay_id", T.LongType()),
    T.StructField("prompt_id", T.IntegerType()),
    T.StructField("score", T.IntegerType()),
    T.StructField("proficiency_level", T.StringType()),
    T.StructField("trait_idx", T.IntegerType()),
    T.StructField("completion", T.StringType()),
])


def scored_trait_stream(spark: SparkSession, source_dir: str, schema: T.StructType = LONG_COMPLETION_SCHEMA,
                        pattern: str = C.TRAIT_SCORE_PATTERN, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of ``(…, trait_idx, trait_score)`` over parquet files landing in ``source_dir``."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    stream = reader.parquet(source_dir)
    scored = TR.with_trait_score(stream, pattern=pattern)
    return scored.drop("completion")


def start_scoring(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                  once: bool = False, **kw) -> StreamingQuery:
    """Append scored traits to ``sink_dir`` (parquet); ``once`` processes what is there and stops."""
    w = scored_trait_stream(spark, source_dir, **kw).writeStream.format("parquet").option(
        "checkpointLocation", checkpoint_dir).outputMode("append")
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime="30 seconds")
    return w.start(sink_dir)
