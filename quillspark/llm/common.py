"""Helpers shared by the corpus operators."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.sinks import materialize
from quillspark.sources.tables import read_table

#: Bytes that end a lower-case word of letters and digits: all of ASCII but 0-9, A-Z, a-z. A-Z become a-z.
ALNUM_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: A-Z to a-z, every other byte as it is.
LOWER_TABLE = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read again (cuts the lineage, survives lost executors)."""
    return materialize(df.sparkSession, df, name)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def text_bytes(text: str = "text") -> Column:
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(text).cast("binary"), F.lit(b"").cast("binary"))


def broadcast_rows(df: DataFrame, most: int = 200_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows; beyond that Spark joins it by shuffling."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Bytes of a batch that a function gets at once; one row may be larger.
PART = 4 << 20


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows of about PART bytes, so that memory doesn't grow with the batch."""
    step = max(1, int(batch.num_rows * min(1.0, PART / max(batch.nbytes, 1))))
    return (batch.slice(i, step) for i in range(0, batch.num_rows, step))


def free_memory() -> None:
    """Gives the memory that a finished task has left free in its worker back to the system: workers live on, and Spark keeps
    idle ones for a minute."""
    import ctypes

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def by_batch(schema: str, make: Callable[[], Callable[[pa.RecordBatch], list]]) -> Callable:
    """A ``mapInArrow`` function: ``make()`` runs once per task and gives the function from a batch to result columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in chain.from_iterable(map(parts, batches)):
            columns = work(batch)
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)
        columns = batch = work = None
        free_memory()

    return run


def map_batches(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], list]]) -> DataFrame:
    return df.mapInArrow(by_batch(schema, make), schema)


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file (base64 token and rank per line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; ``QUILL_TOKENIZERS`` names another folder."""
    if folder := os.environ.get("QUILL_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
