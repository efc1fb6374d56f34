"""File sources and sinks round-trip the driver's tables exactly."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from quillspark.operators import dataset as DS
from quillspark.session import scratch_path
from quillspark.sources import files as FL
from quillspark.sources import fixtures as fx
from quillspark.sources import sinks as SK


def test_tsv_roundtrip_keeps_text(spark):
    src = fx.raw_ratings(spark, SF_SMALL)
    path = SK.write_delimited(src, scratch_path(spark, "t-tsv"), sep="\t", header=True)
    back = FL.read_rated_corpus(spark, path, multi_line=True)
    assert back.schema == FL.RATED_CORPUS_SCHEMA
    assert src.exceptAll(back).count() == 0 and back.exceptAll(src).count() == 0


def test_text_with_quotes_newlines_and_spaces(spark):
    rows = [("a.txt", "P1", ' "quoted", comma\nnew line  '), ("b.txt", "P2", "")]
    df = spark.createDataFrame(rows, "path string, prompt_id string, proficiency_level string")
    path = SK.write_delimited(df, scratch_path(spark, "t-csv"))
    assert sorted(FL.read_index(spark, path, multi_line=True).collect()) == sorted(df.collect())


def test_wholetext_files_keyed_by_name(spark):
    docs = spark.createDataFrame([("1.txt", "  one\n"), ("2.txt", "two \n\n")], "path string, essay string")
    path = SK.write_text_files(docs, scratch_path(spark, "t-files"), "path", "essay")
    got = {r["file_name"]: r["text"] for r in FL.read_text_files(spark, path, name_partition="path").collect()}
    assert got == {"1.txt": "one", "2.txt": "two"}


def test_overrides_and_rescore(spark):
    raw = fx.raw_ratings(spark, SF_SMALL)
    first = raw.select("essay_id").orderBy("essay_id").first()[0]
    out = DS.apply_overrides(spark, raw, [(first, 99.0)])
    assert out.where(F.col("essay_id") == first).first()["domain1_score"] == 99.0
    assert out.columns == raw.columns
    r7 = DS.weighted_rescore(raw).where("essay_set = 7").first()
    assert r7["domain1_score"] == (2 * r7["rater1_trait1"] + r7["rater1_trait2"] + r7["rater1_trait3"] + r7["rater1_trait4"]
                                   + 2 * r7["rater2_trait1"] + r7["rater2_trait2"] + r7["rater2_trait3"] + r7["rater2_trait4"])


def test_dense_index_over_many_partitions(spark):
    df = spark.range(0, 5000).select(F.format_string("k%06d", (F.col("id") * 7919) % 5000).alias("path")).repartition(5)
    got = DS.dense_index(spark, df, "path", "essay_id", partitions=17).collect()
    ids = sorted((r["path"], r["essay_id"]) for r in got)
    assert [i for _, i in ids] == list(range(5000))


def test_dense_index_with_equal_and_null_keys(spark):
    rows = [("hot",)] * 3000 + [(None,)] * 1000 + [(f"k{i}",) for i in range(500)]
    df = spark.createDataFrame(rows, "path string").repartition(4)
    out = DS.dense_index(spark, df, "path", "essay_id", partitions=16)
    got = sorted(((r["path"] is not None, r["path"] or ""), r["essay_id"]) for r in out.collect())
    assert [i for _, i in got] == list(range(4500))
    assert DS.dense_index(spark, df.limit(0), "path").collect() == []


def test_columns_by_name(spark):
    rows = spark.createDataFrame([("P3", "a.txt", "FR", "high")], "Prompt string, Filename string, Language string, `Score Level` string")
    path = SK.write_delimited(rows, scratch_path(spark, "lang"), header=True)
    assert [tuple(r) for r in FL.read_languages(spark, path).collect()] == [("a.txt", "FR")]
    bad = SK.write_delimited(rows.drop("Language"), scratch_path(spark, "lang"), header=True)
    with pytest.raises(ValueError, match="Language"):
        FL.read_languages(spark, bad)


def test_value_that_does_not_fit_is_an_error(spark):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("x", T.DoubleType())])
    rows = spark.createDataFrame([("7", "1.5"), (" 8.0 ", None), (None, "2")], "n string, x string")
    path = SK.write_delimited(rows.select("x", "n"), scratch_path(spark, "typed"), header=True)
    assert sorted(map(tuple, FL.read_delimited(spark, path, schema, header=True).collect()), key=str) == [(7, 1.5), (8, None), (None, 2.0)]
    path = SK.write_delimited(rows.select(F.lit("x").alias("n"), "x"), scratch_path(spark, "typed"), header=True)
    with pytest.raises(Exception, match="column n"):
        FL.read_delimited(spark, path, schema, header=True).collect()


def test_lines_are_split_unless_asked(spark):
    rows = spark.createDataFrame([(f"{i}.txt", "P1", "low") for i in range(20_000)], "path string, prompt_id string, proficiency_level string").coalesce(1)
    path = SK.write_delimited(rows, scratch_path(spark, "big"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        assert FL.read_index(spark, path).rdd.getNumPartitions() > 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def _folder(spark, files):
    import os
    import tempfile

    folder = tempfile.mkdtemp(prefix="quill-flat-")
    for name, text in files.items():
        with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
            f.write(text)
    return folder


def test_flat_folder_names(spark):
    files = {"a b.txt": " one ", "007": "two", "c+d é.txt": "three\n", "e%20f.txt": "four"}
    got = {r["file_name"]: r["text"] for r in FL.read_text_files(spark, _folder(spark, files)).collect()}
    assert got == {k: v.strip() for k, v in files.items()}


def test_partition_folder_names_are_not_inferred(spark):
    docs = spark.createDataFrame([("007", "x"), ("a b:c.txt", "y"), ("1e3", "z")], "name string, essay string")
    path = SK.write_text_files(docs, scratch_path(spark, "named"), "name", "essay")
    got = {r["file_name"]: r["text"] for r in FL.read_text_files(spark, path, name_partition="name").collect()}
    assert got == {"007": "x", "a b:c.txt": "y", "1e3": "z"}


def test_missing_essay_file_is_an_error_and_ids_come_before_languages(spark):
    from quillspark.plans.organize import organize_proficiency_corpus

    index = spark.createDataFrame([(n, "P1", "low") for n in ("a b.txt", "b.txt", "c.txt")], "path string, prompt_id string, proficiency_level string")
    index_path = SK.write_delimited(index, scratch_path(spark, "idx"))
    langs = spark.createDataFrame([("c.txt", "DE"), ("a b.txt", "FR")], "Filename string, Language string")
    lang_path = SK.write_delimited(langs, scratch_path(spark, "lang"), header=True)
    whole = _folder(spark, {"a b.txt": "A", "b.txt": "B", "c.txt": "C"})
    rows = organize_proficiency_corpus(spark, index_path, whole, lang_path, with_id=True).collect()
    assert {(r["path"], r["essay_id"], r["essay"]) for r in rows} == {("a b.txt", 0, "A"), ("c.txt", 2, "C")}
    with pytest.raises(Exception, match="no essay file, or an empty one, for b.txt"):
        organize_proficiency_corpus(spark, index_path, _folder(spark, {"a b.txt": "A", "c.txt": "C"})).collect()


def test_missing_score_is_an_error(spark):
    raw = fx.raw_ratings(spark, SF_SMALL).withColumn("domain1_score", F.lit(None).cast("double"))
    with pytest.raises(Exception, match="no score for essay"):
        DS.canonical(raw).collect()


def test_report_from_saved_scores(spark):
    from quillspark.plans import evaluate as E
    comp = fx.completions(spark, SF_SMALL)
    path = scratch_path(spark, "scored")
    a = sorted(E.eval_mts_numeric(spark, comp, save_to=path).collect())
    b = sorted(E.eval_mts_numeric(spark, comp).collect())
    assert a == b
    assert {"essay_id", "score_agg", "score_map", "score_pred"} <= set(spark.read.parquet(path).columns)


def test_organize_proficiency_corpus_with_languages(spark):
    from quillspark.plans.organize import organize_proficiency_corpus

    e = fx.essays(spark, SF_SMALL)
    files = e.select(F.concat(F.col("essay_id").cast("string"), F.lit(".txt")).alias("path"), "essay")
    text_dir = SK.write_text_files(files, scratch_path(spark, "ess"), "path", "essay")
    index = SK.write_delimited(fx.index_rows(spark, SF_SMALL), scratch_path(spark, "idx"))
    langs = SK.write_delimited(fx.language_rows(spark, SF_SMALL), scratch_path(spark, "lang"), header=True)
    d = organize_proficiency_corpus(spark, index, text_dir, languages=langs, name_partition="path", with_id=True)
    assert set(d.columns) == {"path", "prompt_id", "proficiency_level", "essay", "language", "essay_id"}
    rows = d.collect()
    assert len(rows) == 200
    assert sorted(r["essay_id"] for r in rows) == list(range(200))
    by_path = {r["path"]: r for r in rows}
    exp = {f"{r['essay_id']}.txt": r for r in e.collect()}
    for p, r in by_path.items():
        assert r["language"] == exp[p]["language"] and r["prompt_id"] == exp[p]["prompt_id"]
        assert r["essay"] == exp[p]["essay"].strip()
    ordered = sorted(by_path)
    assert [by_path[p]["essay_id"] for p in ordered] == list(range(200))


def test_a_folder_for_each_essay_is_written_by_the_tasks(spark):
    """Keys that need escapes, repeated, empty and null ones, as Spark's writer lays them out; its commit took 20 ms a key."""
    import time

    docs = [("a=b/c:%.txt", "x"), ("twice", "1"), ("twice", "2"), ("", "none"), (None, None), ("ü [1]", "")]
    df = spark.createDataFrame(docs, "name string, essay string").coalesce(1)
    path, plain = SK.write_text_files(df, scratch_path(spark, "own"), "name", "essay"), scratch_path(spark, "plain")
    df.write.partitionBy("name").text(plain)
    read = lambda p: sorted(map(tuple, FL.read_text_files(spark, p, strip=False, name_partition="name").collect()))
    assert read(path) == read(plain)
    assert ("twice", "1\n2\n") in read(path)
    with pytest.raises(Exception, match="exists"):
        SK.write_text_files(df, path, "name", "essay")
    many = spark.range(3000).select(F.concat("id", F.lit(".txt")).alias("name"), F.col("id").cast("string").alias("essay"))
    began = time.time()
    path = SK.write_text_files(many, scratch_path(spark, "many"), "name", "essay")
    files = FL.read_text_files(spark, path, name_partition="name")
    assert files.where("concat(text, '.txt') = file_name").count() == 3000
    assert time.time() - began < 20
    assert files.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism


def test_flat_files_are_packed_into_few_tasks(spark):
    import gzip
    import os

    many = spark.range(2000).select(F.concat("id", F.lit(".txt")).alias("name"), F.col("id").cast("string").alias("essay"))
    path = SK.write_flat_text_files(many, scratch_path(spark, "many"), "name", "essay")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")  # a file a split
    try:
        files = FL.read_text_files(spark, path)
        assert files.where("concat(text, '.txt') = file_name").count() == 2000
        assert FL.few_tasks(spark.read.format("binaryFile").load(path)).rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    folder = _folder(spark, {"a": "plain"})
    with open(os.path.join(folder, "b.gz"), "wb") as f:
        f.write(gzip.compress(b"packed"))
    assert sorted(map(tuple, FL.read_text_files(spark, folder).collect())) == [("a", "plain"), ("b.gz", "packed")]


def _no_list_in_the_driver(spark, files, n):
    """The driver's plan holds no file, and a frame whose planned size is that of its names is not broadcast."""
    assert list(files.inputFiles()) == []
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        joined = spark.range(n).select(F.concat("id", F.lit(".txt")).alias("path")).join(files, F.col("path") == F.col("file_name"), "left")
        assert joined.where("concat(text, '.txt') = path").count() == n
        joined.write.format("noop").mode("overwrite").save()
        joined.collect()
        assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_folder_for_each_essay_is_listed_by_tasks(spark):
    """The driver listed every folder and file: 1.3 KB of its heap for each."""
    import os

    from quillspark.session import ScratchScope, path_exists

    many = spark.range(2000).select(F.concat("id", F.lit(".txt")).alias("name"), F.col("id").cast("string").alias("essay"))
    with ScratchScope(spark) as scope:
        path = SK.write_text_files(many, scratch_path(spark, "many"), "name", "essay")
        files = scope.keep(FL.read_text_files(spark, path, name_partition="name"))
    assert scope.paths == [path]
    _no_list_in_the_driver(spark, files, 2000)
    root = path.removeprefix("file:")
    for name, text in {"name=deep/a/b": "deep", "top/name=below/part-0": "below", "name=no bytes/part-0": "", "_hidden/name=x/part-0": "x", "name=y/.part-0": "y", "loose": "loose"}.items():
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "w", encoding="utf-8") as f:
            f.write(text)
    found = sorted(map(tuple, files.where("not file_name rlike '^[0-9]'").collect()))
    assert found == [("", "deep"), ("", "loose"), ("below", "below")]
    assert found == sorted(map(tuple, FL.read_text_files(spark, f"{path}*", name_partition="name").where("not file_name rlike '^[0-9]'").collect()))
    scope.release()
    assert not path_exists(spark, path)


def test_packed_files_are_unpacked_by_tasks(spark):
    """As Spark's text reader does it, by the name's end; texts longer than a codec's block, several streams in one file."""
    import gzip
    import os
    import random
    import shutil

    import pyarrow as pa

    random.seed(3)
    rows = [("x" * 300_000,), ("drü\n" * 9,), ("".join(random.choices("abcdefgh ", k=600_000)),), ("é" * 70_000 + "end",)]
    docs, folder = spark.createDataFrame(rows, "essay string").coalesce(1), _folder(spark, {"plain.txt": "plain"})
    for codec in ("gzip", "bzip2", "deflate", "lz4", "snappy"):
        docs.write.option("compression", codec).text(out := scratch_path(spark, codec))
        part = next(f for f in os.listdir(out.removeprefix("file:")) if f.startswith("part-"))
        os.mkdir(f"{folder}/name={codec}")
        for to in (f"{folder}/{codec}.{part.rpartition('.')[2]}", f"{folder}/name={codec}/{part}"):
            shutil.copy(f"{out.removeprefix('file:')}/{part}", to)
    with open(f"{folder}/two.gz", "wb") as f:
        f.write(gzip.compress(b"one ") + gzip.compress(b"two"))
    with open(f"{folder}/none.gz", "wb") as f:
        f.write(gzip.compress(b""))
    whole = "".join(f"{r[0]}\n" for r in rows)
    got = {r[0]: r[1] for r in FL.read_text_files(spark, folder, strip=False, name_partition="name").collect() if r[0]}
    assert got == dict.fromkeys(("gzip", "bzip2", "deflate", "lz4", "snappy"), whole)
    assert FL.unpacked("a.zst", pa.compress(whole.encode(), "zstd", asbytes=True)) == whole.encode()
    assert FL.unpacked("a.gz", gzip.compress(b"one ") + gzip.compress(b"two")) == b"one two"
    with pytest.raises(EOFError):
        FL.unpacked("a.lz4", (9).to_bytes(4, "big"))
    by_spark = sorted(map(tuple, FL.read_text_files(spark, f"{folder}*", strip=False, name_partition="name").collect()))
    assert sorted(map(tuple, FL.read_text_files(spark, folder, strip=False, name_partition="name").collect())) == by_spark
    latin = {r[0]: r[1] for r in FL.read_text_files(spark, folder, strip=False, name_partition="name", encoding="ISO-8859-1").collect()}
    assert latin["gzip"].startswith("\x1f")  # other encodings: as it stands


def test_a_flat_folder_is_listed_by_tasks(spark):
    """The driver listed every file: 1.3 KB of its heap for each, and its name once more."""
    import gzip
    import os

    many = spark.range(2000).select(F.concat("id", F.lit(".txt")).alias("name"), F.col("id").cast("string").alias("essay"))
    path = SK.write_flat_text_files(many, scratch_path(spark, "many"), "name", "essay")
    files = FL.read_text_files(spark, path)
    _no_list_in_the_driver(spark, files, 2000)
    root = path.removeprefix("file:")
    odd = {"é d.txt": b" x ", "no bytes": b"", "_hidden": b"h", ".hidden": b"h", "a._COPYING_": b"h", "below/a": b"b", "lang=de/d": b"d", "p.gz": gzip.compress(b"packed"), "none.gz": gzip.compress(b"")}
    for name, content in odd.items():
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "wb") as f:
            f.write(content)
    os.symlink(f"{root}/gone", f"{root}/broken")
    os.symlink(f"{root}/é d.txt", f"{root}/linked")
    found = sorted(map(tuple, files.where("not file_name rlike '^[0-9]'").collect()))
    assert found == sorted([("é d.txt", "x"), ("no bytes", ""), ("d", "d"), ("p.gz", "packed"), ("none.gz", ""), ("linked", "x")])
    assert files.count() == 2000 + len(found)
    plain = _folder(spark, {"a": "1", "b": "2"})
    by_spark = FL.read_text_files(spark, f"{plain}/*")  # a pattern, and one file
    assert sorted(map(tuple, by_spark.collect())) == sorted(map(tuple, FL.read_text_files(spark, plain).collect())) == [("a", "1"), ("b", "2")]
    assert list(map(tuple, FL.read_text_files(spark, f"{plain}/a").collect())) == [("a", "1")]
    named = SK.write_flat_text_files(many.limit(3), scratch_path(spark, "a b%20c"), "name", "essay")
    assert FL.read_text_files(spark, named).count() == 3
    assert FL.read_text_files(spark, _folder(spark, {})).collect() == []
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        FL.read_text_files(spark, f"{plain}-gone")
