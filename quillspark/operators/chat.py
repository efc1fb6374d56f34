"""Message lists for chat models, from composed columns or from a turn table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def conversation_messages(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                          text: str = "text", chunk_turns: int = 256) -> DataFrame:
    """``(conv, turn, role, text)`` rows -> ``(conv, messages array<struct<role, content>>)`` in turn order.

    Turns are ordered inside chunks of ``chunk_turns`` by many tasks; a conversation then only orders
    and flattens its chunk arrays. The message list of one conversation is one row by definition.
    """
    msg = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("content"))
    chunks = turns.select(conv, msg.alias("__m"), F.floor(F.col(turn) / F.lit(chunk_turns)).alias("__chunk"))
    chunks = chunks.groupBy(conv, "__chunk").agg(F.array_sort(F.collect_list("__m")).alias("__ms"))
    gathered = chunks.groupBy(conv).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col("__chunk").alias("o"), F.col("__ms").alias("v")))),
                              lambda x: x["v"])).alias("__turns"))
    msgs = F.transform("__turns", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return gathered.select(conv, msgs.alias("messages"))


def conversation_prompts(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", piece=None, prefix: str | None = None, chunk_turns: int = 256) -> DataFrame:
    """``(conv, prompt)``: every conversation rendered to one prompt string, in turn order.

    Each turn is rendered where it is; turns are joined into strings per chunk of ``chunk_turns``
    (one task per chunk), and a conversation only gathers its few chunk strings. A conversation
    with a huge number of turns is thus assembled by many tasks; only the final string, which is the
    result itself, sits in one row.
    """
    from ..functions import templates as TP

    piece = piece or TP.inst_piece
    prefix = TP.CHAT_PREFIX if prefix is None else prefix
    p = turns.select(conv, F.col(turn).alias("__t"), piece(role, text).alias("__p"),
                     F.floor(F.col(turn) / F.lit(chunk_turns)).alias("__chunk"))

    def ordered_join(order, value):
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))),
                                        lambda x: x["v"]), "")

    chunks = p.groupBy(conv, "__chunk").agg(ordered_join("__t", "__p").alias("__part"))
    return chunks.groupBy(conv).agg(F.concat(F.lit(prefix), ordered_join("__chunk", "__part")).alias("prompt"))
