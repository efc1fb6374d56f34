"""Parquet tables and small parameter tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ASAP, ScoreDomain

def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory: ``{sf_dir}/{name}.parquet``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def score_range(spark: SparkSession, domain: ScoreDomain = ASAP) -> DataFrame:
    """``(prompt_id, s_min, s_max)``: one row per listed prompt of the domain (possibly none)."""
    rows = domain.range_rows()
    if not rows:
        return spark.createDataFrame([], "prompt_id int, s_min int, s_max int")
    return local_table(spark, rows, ["prompt_id", "s_min", "s_max"])


def with_range(df: DataFrame, spark: SparkSession, domain: ScoreDomain = ASAP, key: str = "prompt_id") -> DataFrame:
    """``df`` plus ``s_min, s_max``: the listed range of the row's prompt, else the domain's default.

    No row is lost: a null prompt, and an unlisted prompt of a domain without default, get nulls. The joined table is
    built from the configuration (one row per listed prompt), so broadcasting it is safe.
    """
    lo, hi = domain.default or (None, None)
    default = [F.when(F.col(key).isNotNull(), F.lit(x)).cast("int") for x in (lo, hi)]
    if not domain.ranges:
        return df.withColumn("s_min", default[0]).withColumn("s_max", default[1])
    r = score_range(spark, domain).withColumnRenamed("prompt_id", "__range_key")
    joined = df.join(F.broadcast(r), F.col(key) == F.col("__range_key"), "left").drop("__range_key")
    return joined.withColumn("s_min", F.coalesce("s_min", default[0])).withColumn("s_max", F.coalesce("s_max", default[1]))


def local_table(spark: SparkSession, rows, names) -> DataFrame:
    """A small driver-side table as an inline ``VALUES`` relation.

    Unlike ``createDataFrame`` (an RDD scan, a new one per call), a local relation compares equal
    across calls, so plans that use the table twice can reuse each other's exchanges.
    """
    def lit(v):
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        return str(int(v))

    values = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")


#: Rows up to which a table may be broadcast.
BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows; a larger one is joined by shuffling.

    Counts the table, so use it on tables that are cheap to read (templates, written aggregates).
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
