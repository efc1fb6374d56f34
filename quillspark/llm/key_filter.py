"""A fixed-size bitmap of keys, so that a scan can leave out rows whose key is surely not wanted.

The bitmap has about eight bits for each key, at most ``MOST_BITS``: that bound holds for any input, so it may be
broadcast. A wanted key always passes; some others pass too, and the exact join that follows drops them. Beyond the
bound more of these pass, which costs shuffled rows but changes no result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 32 MB.
MOST_BITS = 1 << 28
LEAST_BITS = 1 << 16


class KeyFilter:
    """Broadcast bitmap over the low bits of 64-bit keys that are hashes."""

    def __init__(self, keys: DataFrame, column: str) -> None:
        spark = keys.sparkSession
        wanted = 8 * keys.count()
        self.bits = LEAST_BITS
        while self.bits < min(wanted, MOST_BITS):
            self.bits *= 2
        low = F.col(column).bitwiseAND(F.lit(self.bits - 1))
        words = keys.select(F.shiftright(low, 6).alias("word"), F.expr(f"shiftleft(1L, cast({column} & 63L AS int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bit"))
        got = words.toArrow()
        bitmap = np.zeros(self.bits // 64, np.uint64)
        bitmap[got["word"].to_numpy()] = got["bit"].to_numpy().view(np.uint64)
        self.bitmap = spark.sparkContext.broadcast(bitmap.tobytes())

    def tester(self):
        """``(broadcast, bits)`` for :func:`may_hold` inside tasks."""
        return self.bitmap, self.bits


def may_hold(bitmap: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    low = keys.view(np.uint64) & np.uint64(bits - 1)
    return (bitmap[low >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1) != 0
