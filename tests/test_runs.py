"""File order, empty files, encodings, spreadsheets, tau-b of real numbers, exact deviations, rejected rows, broken inference
and scratch tables."""

import io
import os
import tempfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SF_SMALL
from quillspark import config as C
from quillspark.operators import dataset as DS
from quillspark.operators import infer as INF
from quillspark.operators import metrics as M
from quillspark.operators import moments
from quillspark.operators.completion_store import complete
from quillspark.plans import evaluate as E
from quillspark.plans.organize import organize_proficiency_corpus
from quillspark.plans.rejects import REASONS, reject_report
from quillspark.session import ScratchScope, path_exists, scratch_path
from quillspark.sources import files as FL
from quillspark.sources import fixtures as fx
from quillspark.sources import sinks as SK
from quillspark.sources import spreadsheets as XL


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def folder(files):
    path = tempfile.mkdtemp(prefix="quill-flat-")
    for name, content in files.items():
        with open(os.path.join(path, name), "wb") as f:
            f.write(content)
    return path


# ------------------------------------------------------------------ files


def test_file_of_no_bytes_is_an_empty_essay(spark):
    path = folder({"a b.txt": b" one ", "empty.txt": b"", "c+d%.txt": "drü\n".encode()})
    assert rows(FL.read_text_files(spark, path)) == [("a b.txt", "one"), ("c+d%.txt", "drü"), ("empty.txt", "")]
    assert rows(FL.read_text_files(spark, folder({"x": b""}))) == [("x", "")]
    index = spark.createDataFrame([(n, "P1", "low") for n in ("a b.txt", "empty.txt")], "path string, prompt_id string, proficiency_level string")
    got = organize_proficiency_corpus(spark, SK.write_delimited(index, scratch_path(spark, "idx")), path)
    assert {(r["path"], r["essay"]) for r in got.collect()} == {("a b.txt", "one"), ("empty.txt", "")}
    more = SK.write_delimited(index.union(index.limit(1).withColumn("path", F.lit("gone.txt"))), scratch_path(spark, "idx"))
    with pytest.raises(Exception, match="for gone.txt"):
        organize_proficiency_corpus(spark, more, path).collect()


def test_flat_folder_writer(spark):
    docs = [("a b.txt", "x\ny"), ("empty", ""), ("none", None), ("ü.txt", "é")]
    path = SK.write_flat_text_files(spark.createDataFrame(docs, "name string, essay string").repartition(3), scratch_path(spark, "flat"), "name", "essay")
    assert rows(FL.read_text_files(spark, path, strip=False)) == sorted([(n, t or "") for n, t in docs], key=repr)


def test_other_encodings(spark):
    path = folder({"a": "Größe é".encode("latin-1"), "b": b""})
    assert rows(FL.read_text_files(spark, path, encoding="ISO-8859-1")) == [("a", "Größe é"), ("b", "")]
    wide = folder({"x.tsv": "n\tText\n7\tdrü\n8\t日本\n".encode("utf-16")})
    schema = T.StructType([T.StructField("Text", T.StringType()), T.StructField("n", T.IntegerType())])
    assert rows(FL.read_delimited(spark, wide, schema, sep="\t", header=True, multi_line=True, encoding="UTF-16")) == [("drü", 7), ("日本", 8)]


def test_file_order_over_many_splits(spark):
    rng = np.random.default_rng(3)
    lines = [(f"{rng.integers(0, 900)}.txt", f"P{i % 8 + 1}", f"row {i}") for i in range(6000)]
    path = folder({"index.csv": "".join(",".join(r) + "\n" for r in lines).encode()})
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        index = FL.read_index(spark, path, order="place")
        assert index.rdd.getNumPartitions() > 10
        ids = DS.dense_index(spark, index, "place", "essay_id").select("essay_id", "path", "prompt_id", "proficiency_level").collect()
        first = DS.distinct_by(index, "path", ("proficiency_level",), order="place").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(map(tuple, ids)) == [(i, *r) for i, r in enumerate(lines)]
    want = {}
    for name, _, level in lines:
        want.setdefault(name, level)
    assert {r["path"]: r["proficiency_level"] for r in first} == want


def test_ids_in_file_order(spark):
    names = ["z.txt", "a.txt", "m.txt"]
    path = folder({"index.csv": "".join(f"{n},P1,low\n" for n in names).encode()})
    got = organize_proficiency_corpus(spark, path, folder({n: n.encode() for n in names}), with_id=True, id_order="file")
    assert {r["essay_id"]: r["essay"] for r in got.collect()} == dict(enumerate(names))
    with pytest.raises(ValueError, match="id_order"):
        organize_proficiency_corpus(spark, path, path, id_order="size")


# ------------------------------------------------------------------ spreadsheets

XL_SCHEMA = T.StructType([T.StructField("text", T.StringType()), T.StructField("n", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("ok", T.StringType())])
XL_ROWS = [
    ("plain", 1, 0.1, "true"), (None, None, None, None), ("", 0, -0.0, "false"), ("line\nbreak\r\nand\ttab \x00\x0b _x0041_ <&>\"'", 1 << 53, 1e300, "true"),
    ("  outer  ", -7, float("inf"), "x"), ("\U0001f600 ￾日本", 3, 5e-324, None), ("long " * 20_000, 2, 1 / 3, ""),
]


def test_workbooks_are_of_bounded_size(spark, monkeypatch):
    """A partition of many characters gives several workbooks; a task that reads holds none that grows with the input."""
    from pyspark import cloudpickle

    monkeypatch.setattr(XL, "BOOK_CHARS", 100_000)
    cloudpickle.register_pickle_by_value(XL)  # tasks see the smaller bound
    try:
        df = spark.range(0, 400, 1, 1).select(F.concat(F.col("id"), F.repeat(F.lit("x"), 2000)).alias("text"), "id")
        path = XL.write_xlsx(df, scratch_path(spark, "books"))
    finally:
        cloudpickle.unregister_pickle_by_value(XL)
    assert spark.read.format("binaryFile").load(path).count() == 9
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("id", T.LongType())])
    assert rows(XL.read_xlsx(spark, path, schema)) == rows(df)


def test_workbooks_come_back(spark):
    df = spark.createDataFrame(XL_ROWS, "text string, n long, x double, ok string").withColumn("extra", F.lit(True)).repartition(3)
    path = XL.write_xlsx(df, scratch_path(spark, "books"))
    want = [(t, n, None if x == float("inf") else x, ok) for t, n, x, ok in XL_ROWS]
    assert rows(XL.read_xlsx(spark, path, XL_SCHEMA)) == sorted(want, key=repr)
    assert {r[0] for r in XL.read_xlsx(spark, path, T.StructType([T.StructField("extra", T.StringType())])).collect()} == {"true"}


def test_full_sheets_empty_tables_and_order(spark):
    df = spark.range(25).coalesce(1).withColumnRenamed("id", "n")
    schema = T.StructType([T.StructField("n", T.LongType())])
    path = XL.write_xlsx(df, scratch_path(spark, "books"), most=11)
    got = XL.read_xlsx(spark, path, schema, order="place")
    assert [r["n"] for r in got.orderBy("place").collect()] == list(range(25))
    assert got.select("place.file").distinct().count() == 3
    empty = XL.write_xlsx(df.limit(0), scratch_path(spark, "books"))
    assert XL.read_xlsx(spark, empty, schema).collect() == []
    with pytest.raises(Exception, match="has no column m"):
        XL.read_xlsx(spark, path, T.StructType([T.StructField("m", T.LongType())])).collect()


def _foreign_book():
    """As spreadsheet programs write them: shared strings, rich text, gaps, formulas, errors, a second sheet."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    parts = {
        "xl/workbook.xml": f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>'
                           '<sheet name="Notes" sheetId="1" r:id="rId7"/><sheet name="Data" sheetId="2" r:id="rId8"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                                      '<Relationship Id="rId7" Target="worksheets/a.xml"/><Relationship Id="rId8" Target="/xl/worksheets/b.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst {ns}><si><t>text</t></si><si><t>n</t></si><si><r><t>ri</t></r><r><rPr/><t xml:space="preserve">ch </t></r><rPh><t>no</t></rPh></si></sst>',
        "xl/worksheets/a.xml": f'<worksheet {ns}><sheetData/></worksheet>',
        "xl/worksheets/b.xml": f'<worksheet {ns}><sheetData><row r="1"><c r="B1" t="s"><v>0</v></c><c r="D1" t="s"><v>1</v></c></row>'
                               '<row r="3"><c r="B3" t="s"><v>2</v></c><c r="C3"><v>9</v></c><c r="D3"><v>4.0</v></c></row><row r="4"/>'
                               '<row r="5"><c r="B5" t="str"><f>A1</f><v>made</v></c><c r="D5" t="e"><v>#N/A</v></c></row>'
                               '<row r="6"><c/><c><v>12.50</v></c></row></sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_workbooks_of_other_programs(spark):
    schema = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("text", T.StringType())])
    path = folder({"book.xlsx": _foreign_book()})
    assert rows(XL.read_xlsx(spark, path, schema, sheet="Data")) == sorted([(4, "rich "), (None, "made"), (None, "12.50")], key=repr)
    with pytest.raises(Exception, match="no sheet"):
        XL.read_xlsx(spark, path, schema, sheet="Other").collect()


# ------------------------------------------------------------------ tau-b and deviations


def brute_tau(a, b):
    s = 0
    for i in range(0, len(a), 500):
        s += int((np.sign(a[i : i + 500, None] - a[None]) * np.sign(b[i : i + 500, None] - b[None])).sum())
    ties = lambda v: sum(int(t) * (int(t) - 1) // 2 for t in np.unique(v, return_counts=True)[1])
    total = len(a) * (len(a) - 1) // 2
    return round(s / 2 / np.sqrt(total - ties(a)) / np.sqrt(total - ties(b)), 3)


def test_tau_of_20000_real_pairs(spark):
    rng = np.random.default_rng(8)
    a = rng.random(20_000)
    b = a + rng.random(20_000)
    a[:6000] = 0.25  # one value of a, and pairs that repeat
    b[:50] = b[0]
    df = spark.createDataFrame([("p", float(x), float(y)) for x, y in zip(a, b)], "prompt_id string, a double, b double").repartition(7)
    want = [("p", 20_000, brute_tau(a, b))]
    assert rows(M.kendall_tau_b(df, "a", "b")) == want
    assert rows(M.tau_from_cells(M.contingency(df, "a", "b"), block_cells=1500)) == want


def test_tau_by_blocks_grows_with_the_cells(spark, monkeypatch):
    """Blocks of few cells: no call for each pair of blocks, no grid of all blocks; values that are cut points, equal and NaN."""
    rng = np.random.default_rng(5)
    n = 6000
    a, b = rng.normal(size=n).round(2), np.where(rng.random(n) < 0.3, 1.5, rng.normal(size=n))
    df = spark.createDataFrame([("p" if i % 3 else "q", float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))], "prompt_id string, a double, b double")
    want = sorted((g, int(k.sum()), brute_tau(a[k], b[k])) for g, k in (("p", np.arange(n) % 3 > 0), ("q", np.arange(n) % 3 == 0)))
    monkeypatch.setattr(M, "grid_score", None)
    cells = M.contingency(df, "a", "b")
    assert rows(M.tau_from_cells(cells, grid_values=5, block_cells=20)) == want
    calls = M._inside(cells.withColumn("block_a", F.lit(0)).withColumn("block_b", F.pmod(F.hash("b"), F.lit(50))), "prompt_id", "block_a", "block_b")
    assert calls.count() == 2


def test_pairs_of_a_part():
    rng = np.random.default_rng(6)
    a, b, c, part = rng.integers(0, 9, 300), rng.integers(0, 9, 300).astype(float), rng.integers(1, 4, 300), rng.integers(0, 20, 300)
    b[:5] = np.nan
    assert M.pair_score(a, b, c, part) == sum(M.pair_score(a[part == p], b[part == p], c[part == p]) for p in range(20))


def test_tau_by_blocks_equals_the_grid(spark):
    rng = np.random.default_rng(9)
    data = [(int(p), int(x), int(x * 3 + rng.integers(-30, 30))) for p, x in zip(rng.integers(0, 3, 3000), rng.integers(0, 60, 3000))]
    cells = M.contingency(spark.createDataFrame([*data, (7, 1, 1), (None, 1, 2)], "prompt_id int, a int, b int"), "a", "b")
    assert rows(M.tau_from_cells(cells, grid_values=5, block_cells=100)) == rows(M.tau_from_cells(cells))


def test_pair_score_of_large_counts():
    a, b, c = np.array([1.0, 2.0, 3.0]), np.array([1.0, 3.0, 2.0]), np.array([3 << 30, 5 << 30, 7 << 30])
    assert M.pair_score(a, b, c) == (3 * 5 + 3 * 7 - 5 * 7) << 60
    assert M.pair_score(a[:0], b[:0], c[:0]) == 0


def test_deviations_do_not_depend_on_the_order(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.random(9000) * 10, 9)
    df = spark.createDataFrame([(float(v),) for v in x], "x double").withColumn("x", F.when(F.rand(1) < 0.97, F.col("x"))).cache()
    got = {df.repartition(n).agg(moments.stddev_samp("x")).first()[0] for n in (1, 3, 8)}
    got.add(df.groupBy("x").count().agg(moments.stddev_samp("x", "count")).first()[0])
    assert len(got) == 1
    known = np.array([r["x"] for r in df.where("x IS NOT NULL").collect()])
    assert abs(got.pop() - np.std(known, ddof=1)) < 1e-13
    offset = spark.createDataFrame([(1e6 + v / 1e9,) for v in range(1000)], "x double")
    assert abs(offset.agg(moments.stddev_samp("x")).first()[0] * 1e9 - np.std(np.arange(1000), ddof=1)) < 0.1
    assert df.limit(1).agg(moments.stddev_samp("x")).first()[0] is None


def test_saved_and_unsaved_reports_agree_on_long_decimals(spark):
    rng = np.random.default_rng(6)
    levels = ["low", "medium", "high"]
    data = [(i, int(i % 3) + 1, levels[int(v)], k, f"Score: {min(10, v * 3 + rng.random() * 4):.9f}") for i, v in enumerate(rng.integers(0, 3, 900)) for k in (1, 2, 3, 4)]
    df = spark.createDataFrame(data, "essay_id long, prompt_id int, proficiency_level string, trait_idx int, completion string").repartition(5)
    a = rows(E.eval_mts_ordinal(spark, df, agg_mode="std_wsum"))
    b = rows(E.eval_mts_ordinal(spark, df, agg_mode="std_wsum", save_to=scratch_path(spark, "scored")))
    assert a == b and len(a) == 4 and all(r[2] is not None for r in a)


# ------------------------------------------------------------------ rejected rows


def test_every_reason_once_and_all_rows(spark):
    domain = C.ScoreDomain(ranges={1: (0, 3), 2: (0, 3), 4: (0, 3)})
    templates = spark.createDataFrame([(1, "s", "i"), (2, None, "i"), (3, "s", "i"), (None, "s", "i")], "prompt_id int, msg_system string, msg_user string")
    scored = spark.createDataFrame([(1, 2), (1, None), (2, 1), (3, 1), (4, 1), (None, 1), (1, 0)], "prompt_id int, score_pred int")
    got = {r["reason"]: r["n_rows"] for r in reject_report(spark, scored, templates, domain).collect()}
    assert got == {"no_prompt": 1, "no_template": 1, "null_template_cell": 1, "no_range": 1, "no_prediction": 1, "kept": 2, "all": 7}
    none = {r["reason"]: r["n_rows"] for r in reject_report(spark, scored.limit(0), templates, domain).collect()}
    assert none == dict.fromkeys([*REASONS, "kept", "all"], 0)


# ------------------------------------------------------------------ inference that goes on


def counting_model(log):
    def make():
        def predict(prompts):
            with open(os.path.join(log, f"{os.getpid()}.txt"), "a") as f:
                f.writelines(f"{p}\n" for p in prompts)
            return np.array([f"Score: {len(p) % 11}" for p in prompts], dtype=object)

        return predict

    return make


def asked(log):
    return sorted(line.rstrip("\n") for name in os.listdir(log) for line in open(os.path.join(log, name)))


def test_a_broken_run_goes_on(spark):
    df = spark.createDataFrame([(i, f"prompt {i % 60}" if i % 13 else None) for i in range(400)], "essay_id long, prompt string")
    store, log = scratch_path(spark, "replies"), tempfile.mkdtemp(prefix="quill-log-")
    half = complete(spark, df, "prompt", "reply", store, counting_model(log), parts=6, only=range(3))
    done = asked(log)
    assert 0 < len(done) == len(set(done)) < 60 and half.where("reply IS NOT NULL").count() < 369

    def breaks():
        def predict(prompts):
            raise RuntimeError("lost")

        return predict

    with pytest.raises(Exception, match="lost"):
        complete(spark, df, "prompt", "reply", store, breaks, parts=6)
    whole = complete(spark, df, "prompt", "reply", store, counting_model(log), parts=6)
    once = complete(spark, df, "prompt", "reply", scratch_path(spark, "replies"), counting_model(tempfile.mkdtemp()), parts=2)
    assert rows(whole) == rows(once) and whole.columns == ["essay_id", "prompt", "reply"]
    assert asked(log) == sorted({f"prompt {i}" for i in range(60)})  # each prompt once, over all runs
    complete(spark, df, "prompt", "reply", store, breaks, parts=6)  # nothing left to ask
    spread = complete(spark, df, "prompt", "reply", store, breaks, parts=6, hot_rows=5)
    assert rows(spread) == rows(once)


def test_two_turns_are_kept_apart(spark):
    from quillspark.operators import compose as CO

    long = CO.compose_mts(fx.essays(spark, SF_SMALL).select("essay_id", "prompt_id", "essay", "score"), fx.template_mts(spark))
    store = scratch_path(spark, "replies")
    a = INF.infer_two_turn(spark, long, store=store, parts=2)
    b = INF.infer_two_turn(spark, long)
    assert rows(a.select(*b.columns)) == rows(b)
    assert path_exists(spark, store + "/turn-1") and path_exists(spark, store + "/turn-2")


def test_seeds_make_a_sampling_model_repeatable(spark):
    df = spark.createDataFrame([(i, "x" * (i % 17)) for i in range(300)], "essay_id long, essay string")
    got = [rows(INF.batch_infer(df, "essay", "reply", INF.sampling_stub_model, num_partitions=n, seed=INF.row_seed("essay_id"), by_length=True)) for n in (1, 8)]
    assert got[0] == got[1] and len({r[2] for r in got[0]}) > 5
    stored = [rows(complete(spark, df, "essay", "reply", scratch_path(spark, "replies"), INF.sampling_stub_model, seeded=True, parts=n)) for n in (1, 3)]
    assert stored[0] == stored[1]


# ------------------------------------------------------------------ scratch tables


def test_scope_removes_what_no_result_needs(spark):
    comp = fx.completions(spark, SF_SMALL)
    with ScratchScope(spark) as scope:
        report = scope.keep(E.eval_mts_numeric(spark, comp))
        gone = SK.materialize(spark, spark.range(3), "gone")
        made = list(scope.paths)
    assert len(scope.paths) >= 1 and set(scope.paths) < set(made)
    assert not any(path_exists(spark, p) for p in set(made) - set(scope.paths))
    assert report.count() == 9
    with pytest.raises(Exception):
        gone.count()
    left = list(scope.paths)
    scope.release()
    assert not any(path_exists(spark, p) for p in left)
    with ScratchScope(spark) as inner:
        E.eval_mts_numeric(spark, comp).collect()
    assert inner.paths == []
    outside = SK.materialize(spark, spark.range(3), "kept")
    assert outside.count() == 3


def test_the_model_gets_few_rows_as_values(spark):
    """Prompts reach the model as arrays of ``batch_size``, nulls as None; a wrong number of replies is an error. No worker makes
    Python texts of a whole Arrow batch."""
    def shapes():
        return lambda prompts: np.array([None if p is None else f"{p}:{len(prompts)}:{type(prompts).__name__}" for p in prompts], dtype=object)

    df = spark.createDataFrame([(i, None if i == 3 else str(i)) for i in range(10)], "id long, essay string").coalesce(1)
    got = rows(INF.batch_infer(df, "essay", "reply", shapes, batch_size=4))
    assert got == [(i, None if i == 3 else str(i), None if i == 3 else f"{i}:{4 if i < 8 else 2}:ndarray") for i in range(10)]
    with pytest.raises(Exception, match="replies"):
        INF.batch_infer(df, "essay", "reply", lambda: lambda p: p[:1]).collect()
    udf = INF.model_udf(INF.length_stub_model, 8, 1)
    assert "pandas" not in str(df.select(udf("essay"))._jdf.queryExecution().executedPlan()).lower()
    assert udf.func.__module__ == INF.__name__  # not predict_batch_udf, whose batches are whole pandas frames
