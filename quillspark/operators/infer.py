"""Batch model inference over prompt columns.

The model call is the one place where rows go to Python: Spark ships Arrow batches, and ``batch_size``
prompts at a time become values for a function built once per Python worker. Model output is
sampled text, so inference results are written out (``materialize``) before anything reads them
twice or a retried stage could recompute them differently.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import templates as TP
from ..sources.sinks import materialize


def length_stub_model() -> Callable[[np.ndarray], np.ndarray]:
    """A deterministic stand-in model: replies ``'Score: ' + str(len(prompt) % 11)``.

    Used by tests and benches; a real deployment passes a factory that loads its model once.
    """
    def predict(prompts: np.ndarray) -> np.ndarray:
        return np.array([None if p is None else f"Score: {len(p) % 11}" for p in prompts], dtype=object)

    return predict


def model_udf(make_predict_fn, batch_size: int, inputs: int):
    """A function of columns that asks the model for ``batch_size`` rows at a time.

    ``predict_batch_udf`` makes Python texts of a whole Arrow batch (up to 64 MB) before the first call; here only the rows of
    a call are, so a worker's memory doesn't follow the length of the texts. Spark 4.0 has no such functions.
    """
    if not hasattr(F, "arrow_udf"):
        return predict_batch_udf(make_predict_fn, return_type=T.StringType(), batch_size=batch_size)
    model = uuid.uuid4()

    def answers(batches) -> Iterator[pa.Array]:
        from pyspark.ml.model_cache import ModelCache

        predict = ModelCache.get(model)
        if not predict:
            predict = make_predict_fn()
            ModelCache.add(model, predict)
        for columns in batches:
            columns = columns if isinstance(columns, tuple) else (columns,)
            out = []
            for at in range(0, len(columns[0]), batch_size):
                rows = [c.slice(at, batch_size).to_numpy(zero_copy_only=False) for c in columns]
                got = predict(*rows)
                if len(got) != len(rows[0]):
                    raise ValueError(f"the model gave {len(got)} replies to {len(rows[0])} prompts")
                out += got.tolist() if isinstance(got, np.ndarray) else list(got)
            yield pa.array(out, pa.string())

    if inputs == 1:
        def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            return answers(batches)
        return F.arrow_udf(one, T.StringType())

    def several(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        return answers(batches)
    return F.arrow_udf(several, T.StringType())


def batch_infer(df: DataFrame, prompt: str, out: str, make_predict_fn=length_stub_model,
                batch_size: int = 8, num_partitions: int | None = None, deterministic: bool = False,
                seed: Column | None = None, by_length: bool = False) -> DataFrame:
    """Add ``out`` = model completion of ``prompt``; ``num_partitions`` rebalances rows first.

    With ``seed`` (a column that follows from the row's key, see ``row_seed``) the model function gets the seeds as a second
    array, so that a sampling model can answer alike however the rows are dealt out. ``by_length`` puts prompts of like
    length into a batch, by sorting each partition.
    """
    if num_partitions:
        df = df.repartition(num_partitions)
    if by_length:
        df = df.sortWithinPartitions(F.length(prompt))
    udf = model_udf(make_predict_fn, batch_size, 1 if seed is None else 2)
    if not deterministic:
        # a sampled model answers differently on every call: Catalyst must neither duplicate nor move it
        udf = udf.asNondeterministic()
    return df.withColumn(out, udf(F.col(prompt)) if seed is None else udf(F.col(prompt), seed))


def row_seed(*keys: str) -> Column:
    """A number from 0 to 2^32 - 1 that follows from the key columns alone (null counts as an empty text)."""
    text = F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def sampling_stub_model() -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A stand-in for a sampling model that follows its seeds: replies ``'Score: ' + str(seed % 11)``."""
    def predict(prompts: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        return np.array([None if p is None else f"Score: {int(s) % 11}" for p, s in zip(prompts, seeds)], dtype=object)

    return predict


def chat_single() -> Column:
    """Message-list form of the single-turn prompt."""
    return TP.render_inst_chat(TP.messages_single())


def chat_retrieval() -> Column:
    return TP.render_inst_chat(TP.messages_single("msg_system", "msg_user_retrieval"))


def chat_two_turn() -> Column:
    """Message-list form (user, assistant, user) of the scoring prompt."""
    return TP.render_inst_chat(TP.messages_two_turn())


@dataclass(frozen=True)
class Renderer:
    """How messages become prompts: single turn, first turn and scoring turn, as functions to a Column."""

    single: Callable[[], Column]
    retrieval: Callable[[], Column]
    two_turn: Callable[[], Column]


INST = Renderer(TP.render_single, TP.render_retrieval, TP.render_two_turn)
CHAT = Renderer(chat_single, chat_retrieval, chat_two_turn)


def _written(spark: SparkSession, df: DataFrame, out: str | None, name: str) -> DataFrame:
    if out is None:
        return materialize(spark, df, name)
    df.write.mode("errorifexists").parquet(out)
    return spark.read.parquet(out)


def infer_vanilla(spark: SparkSession, df: DataFrame, make_predict_fn=length_stub_model, batch_size: int = 8,
                  keep_output: bool = True, num_partitions: int | None = None, renderer: Renderer = INST,
                  out: str | None = None, store: str | None = None, **stored) -> DataFrame:
    """Render the single-turn prompt and complete it: ``prompt`` (the rendered one) and ``msg_assistant`` beside the
    columns that the model call doesn't need again. Written once, to ``out`` if given.

    With ``store`` (a folder) the replies are kept by prompt: a broken run asks only for the rest, equal prompts are asked
    once (``completion_store.complete``, which takes the other arguments).
    """
    sources = {"essay", "prompt", "msg_system", "msg_user_instruction", "msg_user_instruction_template"}
    kept = [c for c in df.columns if c not in sources]
    d = df.select(*kept, renderer.single().alias("prompt"))
    if store:
        from .completion_store import complete

        d = complete(spark, d, "prompt", "msg_assistant", store, make_predict_fn, batch_size, num_partitions=num_partitions, **stored)
        return _written(spark, d, out, "completions-vanilla") if out else d
    d = batch_infer(d, "prompt", "msg_assistant", make_predict_fn, batch_size, num_partitions)
    return _written(spark, d, out, "completions-vanilla") if keep_output else d


def infer_two_turn(spark: SparkSession, long_df: DataFrame, make_predict_fn=length_stub_model, batch_size: int = 8,
                   keep_output: bool = True, num_partitions: int | None = None, renderer: Renderer = INST,
                   out: str | None = None, store: str | None = None, **stored) -> DataFrame:
    """Per ``(essay, trait)``: retrieval prompt -> reply -> two-turn scoring prompt -> reply.

    Both calls run in one pass: the first call is not repeatable, so Catalyst evaluates it once per row, and a retried
    task makes both replies anew before anything is committed. Only keys and replies are written, once, to ``out`` if
    given; prompts can be rendered again from the test set. With ``store`` the replies of each turn are kept by prompt in a
    folder of their own (see ``infer_vanilla``).
    """
    messages = ["msg_system", "msg_user_retrieval", "msg_user_score"]
    gone = {"essay", "trait", "prompt", *messages}
    kept = [c for c in long_df.columns if c not in gone]
    d = long_df.select(*kept, *messages, renderer.retrieval().alias("__retrieval"))
    if store:
        from .completion_store import complete

        ask = dict(make_predict_fn=make_predict_fn, batch_size=batch_size, num_partitions=num_partitions, **stored)
        d = complete(spark, d, "__retrieval", "msg_assistant_retrieval", f"{store.rstrip('/')}/turn-1", **ask)
        d = d.select(*kept, "msg_assistant_retrieval", renderer.two_turn().alias("__score"))
        d = complete(spark, d, "__score", "msg_assistant_score", f"{store.rstrip('/')}/turn-2", **ask).drop("__score")
        return _written(spark, d, out, "completions-score") if out else d
    d = batch_infer(d, "__retrieval", "msg_assistant_retrieval", make_predict_fn, batch_size, num_partitions)
    d = d.select(*kept, "msg_assistant_retrieval", renderer.two_turn().alias("__score"))
    d = batch_infer(d, "__score", "msg_assistant_score", make_predict_fn, batch_size).drop("__score")
    return _written(spark, d, out, "completions-score") if keep_output else d


def infer_wide(spark: SparkSession, wide: DataFrame, make_predict_fn=length_stub_model, batch_size: int = 8,
               renderer: Renderer = INST, n_traits: int = 4, num_partitions: int | None = None) -> DataFrame:
    """Two-turn inference on a wide test set (``msg_system_{k}``, ``msg_user_retrieval_{k}``, ``msg_user_score_{k}``);
    the result is wide too, with ``msg_assistant_retrieval_{k}`` and ``msg_assistant_score_{k}``."""
    from .compose import from_wide, to_wide

    messages = ["msg_system", "msg_user_retrieval", "msg_user_score"]
    long = from_wide(wide, messages, n_traits)
    done = infer_two_turn(spark, long, make_predict_fn, batch_size, True, num_partitions, renderer)
    replies = ["msg_assistant_retrieval", "msg_assistant_score"]
    return to_wide(done, [c for c in done.columns if c not in {"trait_idx", *replies}], replies, n_traits)


def union_groups(frames) -> DataFrame:
    """Concatenate result tables by column name (missing columns become null)."""
    frames = list(frames)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
