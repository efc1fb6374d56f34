"""Sinks. Results are written to new paths; a path being read is never overwritten."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from itertools import groupby
from operator import itemgetter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import path_exists, scratch_path
from .files import TEXT_SAFE_WRITE, task_filesystem


def write_parquet(df: DataFrame, path: str, partition_by=None, mode: str = "errorifexists") -> str:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.parquet(path)
    return path


def write_delimited(df: DataFrame, path: str, sep: str = ",", header: bool = False, mode: str = "errorifexists",
                    encoding: str = "UTF-8") -> str:
    writer = df.write.mode(mode).options(**TEXT_SAFE_WRITE).option("sep", sep).option("header", str(header).lower())
    writer.option("encoding", encoding).csv(path)
    return path


#: Characters that Spark's writers escape in the name of a partition folder.
_ESCAPED = {*map(chr, range(1, 32)), *"\"#%'*/:=?\\\x7f{[]^"}


def partition_folder(key: str, value: str | None) -> str:
    """The folder of a partition value, named as Spark's writers name it."""
    return f"{key}=" + ("".join(f"%{ord(c):02X}" if c in _ESCAPED else c for c in value) if value else "__HIVE_DEFAULT_PARTITION__")


def write_text_files(df: DataFrame, path: str, key: str, text: str, mode: str = "errorifexists") -> str:
    """One text file per distinct ``key`` of a task (layout ``{path}/{key}=<value>/part-*.txt``), each text ended by a line break.

    Spark's own writer commits its files one after the other, at a cost of tens of milliseconds for each key. So the tasks
    write the folders themselves; where they can't reach the store (see ``task_filesystem``) Spark's writer does it.
    """
    try:
        target, root = task_filesystem(path)
        target.get_file_info(root)
    except Exception:  # a store that only Spark's writers know
        df.select(key, text).write.mode(mode).partitionBy(key).text(path)
        return path
    if path_exists(df.sparkSession, path):
        if mode == "ignore":
            return path
        if mode == "overwrite":
            target.delete_dir(root)
        elif mode != "append":
            raise FileExistsError(f"{path} exists")
    target.create_dir(root, recursive=True)
    call = uuid.uuid4().hex[:12]  # files of another call are never written over

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        target, root = task_filesystem(path)
        part = f"part-{TaskContext.get().partitionId():05d}-{call}.txt"
        rows = (row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        files = 0
        for value, group in groupby(rows, itemgetter(0)):
            folder = f"{root}/{partition_folder(key, value)}"
            target.create_dir(folder, recursive=False)
            with target.open_output_stream(f"{folder}/{part}") as f:
                for _, content in group:
                    f.write((content or b"") + b"\n")
            files += 1
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])

    rows = df.select(F.nullif(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(text).cast("binary").alias("text")).sortWithinPartitions("key")
    rows.mapInArrow(write, "files long").agg(F.sum("files")).first()
    return path


def write_flat_text_files(df: DataFrame, path: str, name: str, text: str) -> str:
    """One file per row, called as its ``name`` says, in one flat folder; an empty or null text is a file of no bytes.

    Spark's writers name their files themselves, so the tasks write these. A task that runs again writes the same files
    again. Names must be distinct and hold no slash.
    """
    def write(batches):
        import pyarrow as pa

        target, root = task_filesystem(path)
        target.create_dir(root, recursive=True)
        for batch in batches:
            for file_name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with target.open_output_stream(f"{root}/{file_name}") as f:
                    f.write(content or b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["files"])

    df.select(F.col(name).cast("string"), F.col(text).cast("binary")).mapInArrow(write, "files long").agg(F.sum("files")).first()
    return path


@contextmanager
def shuffles_removed(spark: SparkSession):
    """While tables are written: Spark removes a query's shuffle files when the query ends, not when the driver happens to
    collect its garbage. A written table doesn't need them any more."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def materialize(spark: SparkSession, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to a new table in the shared checkpoint folder and read it back.

    Used after model inference: sampled model output is not repeatable, so it must not be
    recomputed by a retried stage or a second reader. The written table also cuts the lineage.
    """
    path = scratch_path(spark, name)
    with shuffles_removed(spark):
        if partition_by:
            # a folder without rows has no schema to infer
            df.write.partitionBy(partition_by).parquet(path)
            return spark.read.schema(df.schema).parquet(path)
        df.write.parquet(path)
        return spark.read.parquet(path)
