"""Model replies kept by prompt, so that a broken run goes on where it stopped and equal prompts are asked once.

The store is a folder of Parquet tables, one per part of the prompts (dealt out by their key). A part's replies become
visible when its write is committed; whatever is there is not asked again, also not after a part was broken off halfway. The
key is the SHA-256 of the model's name and the prompt, so several models may share a store.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import path_exists
from ..sources.sinks import materialize
from ..sources.tables import broadcast_if_small
from .infer import batch_infer, length_stub_model

STORE = "prompt_key string, completion string"
#: A prompt of more rows than this has its rows spread over SPREAD tasks when replies are joined to them.
HOT_ROWS, SPREAD = 100_000, 64


def prompt_key(prompt: str, model: str) -> Column:
    return F.sha2(F.concat(F.lit(model + "\n"), F.col(prompt)).cast("binary"), 256)


def seed_of(key: Column) -> Column:
    """A seed from the first eight hexadecimal digits of a key."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long")


def stored(spark: SparkSession, store: str) -> DataFrame:
    """``prompt_key, completion`` of the committed parts."""
    if not path_exists(spark, store):
        return spark.createDataFrame([], STORE)
    return spark.read.schema(STORE).option("recursiveFileLookup", "true").parquet(store)


def ask_missing(spark: SparkSession, asked: DataFrame, store: str, make_predict_fn=length_stub_model, batch_size: int = 8,
                parts: int = 16, only: Iterable[int] | None = None, seeded: bool = False, num_partitions: int | None = None) -> None:
    """Completes the prompts of ``asked`` (prompt_key, prompt) that the store lacks, part by part (``only``: these parts).

    Prompts of like length share a batch. With ``seeded`` the model function gets a seed for each prompt beside it, which
    follows from the prompt alone: replies don't depend on partitions or on the run.
    """
    part = F.pmod(F.conv(F.substring("prompt_key", 9, 8), 16, 10).cast("long"), F.lit(parts)).cast("int")
    todo = asked.join(stored(spark, store).select("prompt_key"), "prompt_key", "left_anti").withColumn("part", part)
    todo = materialize(spark, todo, "prompts-to-ask", partition_by="part")
    waiting = {r["part"] for r in todo.select("part").distinct().collect()}  # at most ``parts`` numbers
    for p in sorted(waiting if only is None else waiting & set(only)):
        rows = todo.where(F.col("part") == p).select("prompt_key", "prompt")
        seed = seed_of(F.col("prompt_key")) if seeded else None
        done = batch_infer(rows, "prompt", "completion", make_predict_fn, batch_size, num_partitions, seed=seed, by_length=True)
        done.select("prompt_key", "completion").write.mode("append").parquet(f"{store.rstrip('/')}/part={p:05d}")


def complete(spark: SparkSession, df: DataFrame, prompt: str, out: str, store: str, make_predict_fn=length_stub_model,
             batch_size: int = 8, model: str = "model", parts: int = 16, only: Iterable[int] | None = None, seeded: bool = False,
             num_partitions: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``df`` plus ``out``: the reply to each row's ``prompt``, from the store, after asking for what it lacks.

    A null prompt isn't asked and has a null reply; so have prompts of parts that ``only`` leaves out, until they are asked.
    Rows of one very frequent prompt are spread over tasks in the join.
    """
    keyed = df.withColumn("__key", prompt_key(prompt, model))
    asked = keyed.where(F.col(prompt).isNotNull()).groupBy(F.col("__key").alias("prompt_key")).agg(F.first(prompt).alias("prompt"), F.count("*").alias("rows"))
    asked = materialize(spark, asked, "prompts")
    ask_missing(spark, asked.select("prompt_key", "prompt"), store, make_predict_fn, batch_size, parts, only, seeded, num_partitions)
    replies = stored(spark, store).withColumnRenamed("completion", out)
    hot = asked.where(F.col("rows") > hot_rows).select(F.col("prompt_key").alias("__hot"))
    if hot.limit(1).count() == 0:
        return keyed.join(replies, keyed["__key"] == replies["prompt_key"], "left").drop("__key", "prompt_key")
    hot = broadcast_if_small(hot)
    salted = keyed.join(hot, F.col("__key") == F.col("__hot"), "left")
    salted = salted.withColumn("__salt", F.when(F.col("__hot").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD))).otherwise(F.lit(0).cast("long"))).drop("__hot")
    every = F.when(F.col("__hot").isNotNull(), F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    spread = replies.join(hot, F.col("prompt_key") == F.col("__hot"), "left").select("prompt_key", out, F.explode(every).alias("__copy"))
    joined = salted.join(spread, (F.col("__key") == F.col("prompt_key")) & (F.col("__salt") == F.col("__copy")), "left")
    return joined.drop("__key", "__salt", "__copy", "prompt_key")
