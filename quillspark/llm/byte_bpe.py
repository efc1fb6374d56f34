"""Byte-level BPE encoding and decoding (operator 5).

Each Arrow batch of texts is split by the vocabulary's pattern; the distinct pieces go through the ``tokenizers``
library once, and every text's ids are put together from its pieces. A piece is mapped byte by byte to printable
characters before the merges; decoding reverses that table and joins the bytes, so characters that are split over
several tokens come back whole.

Defined results: a null text counts as empty (no ids); other columns are kept as they are; a column that already has
the name of a result is replaced; repeated rows give repeated results; an empty table gives an empty table. A null id
list decodes to no bytes; an id outside the vocabulary is an error.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load_ranks, map_batches, text_bytes, tokenizer_path

#: Pattern that splits text before the merges (fixed value of the public vocabularies).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RANKS = "byte_bpe_multi_50k.tiktoken"
#: Beyond so many distinct pieces (about 70 MB) a task forgets their ids and starts anew; rare ones seldom come again.
MOST_PIECES = 300_000
#: Characters of the texts whose pieces are put together at once.
RUN = 1 << 18


def byte_chars() -> list[str]:
    """A printable character for each byte: visible Latin-1 characters stand for themselves, the rest for 256, 257, ..."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in visible else next(hidden)) for b in range(256)]


def token_names(ranks: dict[bytes, int]) -> dict[str, int]:
    """Each token's id by its printable name."""
    chars = byte_chars()
    return {"".join(chars[b] for b in t): r for t, r in ranks.items()}


def tokenizer(ranks: dict[bytes, int]):
    """A ``tokenizers.Tokenizer`` that encodes one piece as the ranks say.

    Every way to cut a token into two tokens is a merge, of the token's rank: the lowest rank merges first.
    """
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocab = token_names(ranks)
    name = dict(zip(ranks, vocab))
    merges = [
        (name[t[:i]], name[t[i:]])
        for t in sorted(ranks, key=ranks.__getitem__)
        for i in range(1, len(t))
        if t[:i] in ranks and t[i:] in ranks
    ]
    out = Tokenizer(models.BPE(vocab=vocab, merges=merges, ignore_merges=True))
    out.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return out


class PieceIds(dict):
    """Number of each distinct piece in order of first sight, and the ids of all pieces in one array."""

    def __init__(self, path: str) -> None:
        self.tokenizer = tokenizer(load_ranks(path))
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.new.append(piece)
        return n

    def encode_new(self) -> None:
        ids, counts = [self.ids], [np.diff(self.ends)]
        for at in range(0, len(self.new), 256):
            part = self.new[at : at + 256]
            got = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(got.ids, np.int32))
            counts.append(np.bincount(np.array(got.word_ids, np.int64), minlength=len(part)))
        self.new = []
        self.ids, self.ends = np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def text_runs(texts: list[str]) -> Iterator[list[str]]:
    """Texts in runs of about RUN characters, so that arrays of their pieces stay small (one text may be larger)."""
    run, size = [], 0
    for text in texts:
        run.append(text)
        size += len(text)
        if size >= RUN:
            yield run
            run, size = [], 0
    if run:
        yield run


def encoder(path: str):
    """A function from a list of texts to ``(ends, ids)``: all ids in one array and where each text's ids end."""
    import regex

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
    split, known = regex.compile(PATTERN).findall, PieceIds(path)

    def encode_run(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(known) > MOST_PIECES:
            known.reset()
        parts = [np.fromiter(map(known.__getitem__, split(t)), np.int32) for t in texts]
        known.encode_new()
        pieces = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        begin, length = known.ends[pieces], np.diff(known.ends)[pieces]
        ends = np.cumsum(length)
        ids = known.ids[np.repeat(begin - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)]
        last = np.cumsum([len(p) for p in parts])
        return np.concatenate([[0], ends])[last], ids

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ends, ids, at = [np.zeros(1, np.int64)], [np.zeros(0, np.int32)], 0
        for run in text_runs(texts):
            run_ends, run_ids = encode_run(run)
            ends.append(run_ends.astype(np.int64) + at)
            ids.append(run_ids)
            at += len(run_ids)
        return np.concatenate(ends), np.concatenate(ids)

    return encode


def token_table(path: str) -> list[bytes]:
    """The bytes of each id, through the reversed byte table."""
    back = {c: b for b, c in enumerate(byte_chars())}
    names = token_names(load_ranks(path))
    table = [b""] * (max(names.values()) + 1)
    for name, i in names.items():
        table[i] = bytes(back[c] for c in name)
    return table


def char_offsets(table: list[bytes], ids: list[int]) -> list[tuple[int, int]]:
    """First and last+1 character of each token; a token that holds part of a character counts that character."""
    out, at = [], 0  # at: characters begun so far
    for i in ids:
        begun = sum(b & 0xC0 != 0x80 for b in table[i])
        inside = table[i][0] & 0xC0 == 0x80  # goes on with the character before
        out.append((at - inside, at + begun))
        at += begun
    return out


def _with(df: DataFrame, **types: str) -> tuple[DataFrame, str, list[str]]:
    """``df``, the schema of its other columns plus ``types``, and those columns."""
    kept = [c for c in df.columns if c.lower() not in {k.lower() for k in types}]
    schema = df.select(*[f"`{c}`" for c in kept]).schema
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields] + [f"`{k}` {v}" for k, v in types.items()]
    return df, ", ".join(fields), kept


def encode(docs: DataFrame, text: str = "text", path: str | None = None, offsets: bool = False) -> DataFrame:
    """``docs`` with ``ids array<int>`` and, if asked for, ``offsets array<struct<begin, end>>`` in characters."""
    path = path or tokenizer_path(RANKS)
    types = {"ids": "array<int>"} | ({"offsets": "array<struct<begin:int,end:int>>"} if offsets else {})
    docs, schema, kept = _with(docs, **types)

    def make():
        run, table = encoder(path), token_table(path) if offsets else None

        def work(batch: pa.RecordBatch) -> list:
            ends, ids = run([t or "" for t in batch.column(text).to_pylist()])
            got = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            more = [[[{"begin": a, "end": b} for a, b in char_offsets(table, x)] for x in got.to_pylist()]] if offsets else []
            return [*[batch.column(c) for c in kept], got, *more]

        return work

    wanted = kept if text in kept else [*kept, text]
    return map_batches(docs.select(*[F.col(f"`{c}`") for c in wanted]), schema, make)


def decode(df: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """``df`` with ``decoded binary``: the bytes of its ids."""
    path = path or tokenizer_path(RANKS)
    df, schema, kept = _with(df, decoded="binary")

    def make():
        table = token_table(path)

        def work(batch: pa.RecordBatch) -> list:
            column = batch.column(ids)
            flat, ends = column.flatten().to_numpy(zero_copy_only=False), [0]
            for n in column.value_lengths().fill_null(0).to_pylist():
                ends.append(ends[-1] + n)
            return [*[batch.column(c) for c in kept], [b"".join(map(table.__getitem__, flat[a:b].tolist())) for a, b in zip(ends, ends[1:])]]

        return work

    return map_batches(df.select(*[F.col(f"`{c}`") for c in kept]), schema, make)


def decode_text(data: bytes, rest: bytes = b"") -> tuple[str, bytes]:
    """Text of ``rest + data`` and the bytes of a last character that isn't whole yet, for decoding token by token."""
    import codecs

    step = codecs.getincrementaldecoder("utf-8")("replace")
    out = step.decode(rest + data)
    return out, step.getstate()[0]


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The contract's digest: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` of encoding and then decoding."""
    both = decode(encode(docs.select("doc_id", "text"), path=path).drop("text"), path=path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def same_bytes(docs: DataFrame) -> DataFrame:
    """Whether each text comes back byte for byte."""
    both = decode(encode(docs.select("doc_id", "text")))
    return both.select("doc_id", (F.col("decoded") == text_bytes()).alias("same"))
