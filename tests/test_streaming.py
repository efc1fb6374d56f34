"""The streaming scorer gives the same trait scores as the batch operator."""

from conftest import SF_SMALL
from quillspark.operators import traits as TR
from quillspark.session import scratch_path
from quillspark.sources import fixtures as fx
from quillspark.streaming.completions import start_scoring


def test_stream_matches_batch(spark):
    comp = fx.completions(spark, SF_SMALL)
    src = scratch_path(spark, "stream-src")
    comp.where("prompt_id <= 4").write.parquet(src + "/batch-1")
    sink, ckpt = scratch_path(spark, "stream-sink"), scratch_path(spark, "stream-ckpt")
    q = start_scoring(spark, src + "/*", sink, ckpt, once=True)
    q.awaitTermination(120)
    comp.where("prompt_id > 4").write.parquet(src + "/batch-2")
    q = start_scoring(spark, src + "/*", sink, ckpt, once=True)
    q.awaitTermination(120)
    got = spark.read.parquet(sink).select("essay_id", "trait_idx", "trait_score")
    exp = TR.with_trait_score(comp).select("essay_id", "trait_idx", "trait_score")
    assert got.count() == exp.count() == 800
    assert got.exceptAll(exp).count() == 0
