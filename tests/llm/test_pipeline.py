"""The stages in a row, each against a brute-force version on its own input."""

import hashlib

import corpus_pipeline as P
from quillspark.llm import queries
from quillspark.llm import weak_labels as W

from .conftest import messy_rows, rows_of
from .test_dedup import plain_components, plain_removed
from .test_search_and_lm import plain_report

ITEM = "alpha Beta gamma the of und x1 done end alpha the the"


def test_stages(spark, tmp_path):
    rows = [*messy_rows(), (300, f"so {ITEM} it goes"), (301, "### $$$ %%% &&& ***\n" * 30)]
    docs = spark.createDataFrame([(i, t, "en", "s", 5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    pairs = lambda df: [(r.doc_id, r.text) for r in df.collect()]

    def stage(k, df):
        out = P.STAGES[k][1](spark, df, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        return spark.read.parquet(f"{tmp_path}/{k}")

    judged = W.classify(docs, W.fit(docs))
    good = stage(0, docs)
    assert sorted(r.doc_id for r in good.where("doc_id IS NOT NULL").collect()) == sorted(r.doc_id for r in judged.where("kept AND doc_id IS NOT NULL").collect())
    assert 301 not in {r.doc_id for r in good.collect()}

    lines = stage(1, good)
    assert sorted(pairs(lines), key=repr) == sorted(plain_removed(pairs(good)), key=repr)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in lines.collect())

    single = stage(2, lines)
    before = pairs(lines)
    named, union = plain_components(before)
    assert single.count() == len({union.find(i) for i in range(len(before))})
    assert {r.doc_id for r in single.collect()} == {c for _, _, c in named}

    clean = stage(3, single)
    report = plain_report(pairs(single), [(1, ITEM)])
    assert sorted((r.doc_id for r in clean.collect()), key=repr) == sorted((i for i, *_, bad in report if not bad), key=repr)
    assert 300 not in {r.doc_id for r in clean.collect()}

    last = stage(4, clean)
    want = sorted(((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in pairs(clean)), key=repr)
    assert rows_of(last.select("doc_id", "decoded_sha256")) == want
    assert rows_of(P.run(spark, str(tmp_path)).select("doc_id", "decoded_sha256")) == want


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []


def test_registered():
    import __spark_entry__ as E

    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= set(E.queries()) and set(queries.ORACLE) <= set(E.oracle_sql())


def test_encoder_and_decoder_are_not_held_together(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    out = P.tokens(spark, docs, str(tmp_path))
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted((r.doc_id, r.n_tokens > 0, r.decoded_sha256) for r in out.collect()) == [(1, True, hashlib.sha256(b"some text").hexdigest()), (2, False, hashlib.sha256(b"").hexdigest())]


def test_a_finished_task_gives_its_memory_back(monkeypatch):
    import pyarrow as pa

    from quillspark.llm import common

    freed = []
    monkeypatch.setattr(common, "free_memory", lambda: freed.append(1))
    run = common.by_batch("n long", lambda: lambda batch: [[batch.num_rows]])
    got = run(iter([pa.RecordBatch.from_pydict({"a": [1, 2]})]))
    assert next(got).to_pydict() == {"n": [2]} and not freed
    assert list(got) == [] and freed == [1]
