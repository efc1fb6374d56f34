"""Building the canonical datasets from raw corpora (the steps before composition).

Rated corpus: tab-separated table -> override -> rescore -> clean -> ``(essay_id, prompt_id, essay, score)``.
Proficiency corpus: index CSV + one text file per essay (+ language table) ->
``(essay_id, path, prompt_id, proficiency_level, essay[, language])``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..operators import dataset as DS
from ..sources import files as FL


def organize_rated_corpus(spark: SparkSession, path: str, sep: str = "\t", overrides=C.ASAP_SCORE_OVERRIDES,
                          multi_line: bool = False, encoding: str = "UTF-8") -> DataFrame:
    return DS.organize_rated_corpus(spark, FL.read_rated_corpus(spark, path, sep=sep, multi_line=multi_line, encoding=encoding), overrides)


def organize_proficiency_corpus(spark: SparkSession, index_path: str, text_dir: str, languages: str | None = None,
                                name_partition: str | None = None, with_id: bool = False,
                                id_order: str = "path") -> DataFrame:
    """Index rows joined to their essay files by file name (a bulk equi-join, no per-row reads).

    An index row whose file is missing is an error; a file of no bytes is an empty essay (in the partition layout it is
    missing, see ``read_text_files``). ``with_id`` adds a dense 0-based ``essay_id`` over all index rows, before any row can
    be lost to the language join, and without their texts; ``id_order``: by ``path``, or as the rows stand in the ``file``.
    """
    if id_order not in ("path", "file"):
        raise ValueError(f"unknown id_order {id_order!r}")
    index = FL.read_index(spark, index_path, order="__file_order" if with_id and id_order == "file" else None)
    if with_id:
        index = DS.dense_index(spark, index, "path" if id_order == "path" else "__file_order", "essay_id").drop("__file_order")
    texts = FL.read_text_files(spark, text_dir, name_partition=name_partition)
    d = DS.join_on(index, texts, "path", "file_name", how="left")
    missing = F.raise_error(F.concat(F.lit("no essay file, or an empty one, for "), F.coalesce("path", F.lit("null"))))
    d = d.withColumn("text", F.coalesce("text", missing.cast("string"))).withColumnRenamed("text", "essay")
    d = d.withColumn("prompt_id", DS.parse_prompt_id("prompt_id"))
    if languages is not None:
        lang = FL.read_languages(spark, languages)
        d = DS.join_on(d, lang, "path", "Filename").withColumnRenamed("Language", "language")
    return d


def write_templates(spark: SparkSession, templates: DataFrame, prompt_dir: str, out: str, name_partition: str | None = None) -> DataFrame:
    """Templates with their prompt texts, written to ``out`` and read back."""
    attach_prompt_files(spark, templates, prompt_dir, name_partition).write.mode("errorifexists").parquet(out)
    return spark.read.parquet(out)


def attach_prompt_files(spark: SparkSession, templates: DataFrame, prompt_dir: str, name_partition: str | None = None) -> DataFrame:
    """Templates get their prompt text from ``P{i}.txt`` files, matched by prompt id."""
    return DS.attach_prompts(templates, FL.read_prompt_files(spark, prompt_dir, name_partition=name_partition))


__all__ = ["organize_rated_corpus", "organize_proficiency_corpus", "attach_prompt_files", "write_templates"]
