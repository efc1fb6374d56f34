import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quillspark.llm import decontaminate as D
from quillspark.llm import ngram_lm as M
from quillspark.llm.common import LOWER_TABLE
from quillspark.llm.elias_fano import EliasFano

from .conftest import messy_rows, rows_of

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


# ---- decontamination ----


def plain_report(rows, items):
    out = []
    for i, t in rows:
        w = words(t)
        hit, ids = set(), set()
        for item, text in items:
            q = words(text)
            n = min(10, len(q))
            if n:
                windows = {tuple(q[k : k + n]) for k in range(len(q) - n + 1)}
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) in windows:
                        hit.update(range(k, k + n))
                        ids |= {str(item)} - {"None"}
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def bench_cases():
    rnd = random.Random(12)
    vocabulary = [f"v{i}" for i in range(150)] + ["the", "of"] * 30
    items = [(k, " ".join(rnd.choices(vocabulary, k=rnd.randrange(12, 40)))) for k in range(15)]
    items += [(20, "Short Item"), (21, "word"), (22, None), (23, ""), (24, "the the the the the the the the the the the"), (0, "again another"), (None, "no id here"), (20, "Short Item"), (25, "ñandú Été")]
    rows = []
    for i in range(40):
        q = words(rnd.choice(items)[1])
        a = rnd.randrange(0, max(1, len(q) - 8))
        piece = q[a : a + rnd.randrange(7, 25)]
        rows.append((i, " ".join(rnd.choices(vocabulary, k=15)) + ". " + ", ".join(piece).upper() + "! " + " ".join(rnd.choices(vocabulary, k=10))))
    rows += [(50, items[3][1]), (51, items[3][1] + " " + items[3][1]), (52, "the " * 40), (53, "short  ITEM short item"), (54, "no id here"), (55, "Ñandú été"), (56, "ñandú Été")]
    return rows + messy_rows(), items


def test_report_equals_brute_force(spark):
    rows, items = bench_cases()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, pos int, term string")
    bench = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, size int")
    assert rows_of(D.report(docs, bench)) == plain_report(rows, items)
    kept = D.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    clean = sorted((i for i, *_, bad in plain_report(rows, items) if not bad), key=repr)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == clean


def test_beyond_broadcast_size(spark, monkeypatch):
    rows, items = bench_cases()
    monkeypatch.setattr(D, "broadcast_rows", lambda df, most=0: df)
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(D.report(docs, bench)) == plain_report(rows, items)


def test_empty_tables(spark, messy, nothing):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in D.report(messy, bench).collect())
    assert D.report(nothing, bench).collect() == [] and D.drop_contaminated(messy, bench).count() == messy.count()


def test_proximity(spark):
    item = "red green blue one two three four five six seven"
    near = "red green blue one two x three four five six seven"  # a word came in
    far = "red green blue " + "x " * 30 + "one two three four five six seven"
    docs = spark.createDataFrame([(1, near), (2, far), (3, item), (4, "red six")], "doc_id long, text string")
    q = D.read_items(spark.createDataFrame([(1, item)], "item_id long, text string"))
    index = D.build_index(docs, q.tokens.select("term").distinct())
    ids = lambda df: {r.did for r in df.select("did").collect()}
    assert ids(D.occurrences(index, q)) == {3}
    assert ids(D.near_matches(index, q, missing=0)) == {1, 3}


def plain_near(rows, items, slop, missing):
    """(document, item) with a near window, straight from the definition."""
    count = Counter(w for _, t in rows for w in words(t))
    out = set()
    for doc, text in rows:
        at = {}
        for pos, w in enumerate(words(text)):
            at.setdefault(w, []).append(pos)
        for item, t in items:
            q = words(t)
            n = min(10, len(q))
            allowed = n * missing // 10
            for b in range(len(q) - n + 1 if n else 0):
                offs = sorted(range(b, b + n), key=lambda k: (count[q[k]], k))
                places = {pos - k for k in offs[: allowed + 1] for pos in at.get(q[k], [])}
                if any(sum(any(abs(pos - k - d) <= slop for pos in at.get(q[k], [])) for k in offs) >= n - allowed for d in places):
                    out.add((doc, item))
                    break
    return out


@pytest.mark.parametrize(("slop", "missing"), [(2, 1), (0, 1), (1, 2), (3, 0)])
def test_proximity_equals_brute_force(spark, slop, missing):
    rnd = random.Random(slop)
    vocabulary = [f"v{i}" for i in range(60)] + ["the", "of"] * 8
    items = [(k, " ".join(rnd.choices(vocabulary, k=rnd.randrange(10, 25)))) for k in range(12)] + [(20, "short item"), (21, "the " * 12), (22, "")]
    rows = [(100, "the " * 2000), (101, ""), (102, "short x item")]
    for i in range(60):
        q = words(items[i % 12][1])
        for _ in range(rnd.randrange(4)):  # a word replaced by one that no item has, put in, or left out
            k = rnd.randrange(len(q))
            q[k : k + 1] = rnd.choice([["unseen"], ["other", q[k]], []])
        rows.append((i, " ".join(rnd.choices(vocabulary, k=6) + q + rnd.choices(vocabulary, k=6))))
    q = D.read_items(spark.createDataFrame(items, "item_id long, text string"))
    index = D.build_index(spark.createDataFrame(rows, "doc_id long, text string"), q.tokens.select("term").distinct())
    near = D.near_matches(index, q, slop, missing).join(q.items, "qid").collect()
    assert {(r.did, int(r.item_id)) for r in near} == plain_near(rows, items, slop, missing)


def test_proximity_with_a_replaced_word_and_a_text_of_one_word(spark):
    item = "red green blue one two three four five six seven"
    rows = [(k, item.replace(w, "nowhere")) for k, w in enumerate(item.split())] + [(50, "same " * 20_000), (51, item.replace("red", "x").replace("two", "y"))]
    items = [(1, item), (2, "same " * 30), (3, item.replace("blue", "neverused"))]
    q = D.read_items(spark.createDataFrame(items, "item_id long, text string"))
    index = D.build_index(spark.createDataFrame(rows, "doc_id long, text string"), q.tokens.select("term").distinct())
    near = {(r.did, r.item_id) for r in D.near_matches(index, q).join(q.items, "qid").collect()}
    assert near == {(k, "1") for k in range(10)} | {(2, "3"), (50, "2")}


def test_plan_is_native(spark, messy):
    bench = spark.createDataFrame([(1, "alpha Beta gamma")], "item_id long, text string")
    plan = D.report(messy, bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- language model ----


@pytest.mark.parametrize(("n", "universe"), [(0, 5), (1, 1), (5, 100), (1000, 1000), (1000, 10**9), (5000, 2**64)])
def test_elias_fano(n, universe):
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(0, universe, n, dtype=np.uint64)) if n else np.zeros(0, np.uint64)
    code = EliasFano.from_parts(EliasFano.build(values, universe).parts())
    assert (code.access(np.arange(len(values))) == values).all()
    asked = np.concatenate([values, rng.integers(0, universe, 500, dtype=np.uint64)])
    place = {int(x): i for i, x in enumerate(values)}
    assert code.find(asked).tolist() == [place.get(int(x), -1) for x in asked]


def test_elias_fano_of_repeated_values():
    values = np.array([0, 0, 3, 3, 3, 9, 9], np.uint64)
    assert (EliasFano.build(values, 10).access(np.arange(7)) == values).all()


def plain_model(rows):
    tokens = [(t or "").encode().translate(LOWER_TABLE).split() for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows]
    uni, bi, ctx = Counter(), Counter(), Counter()
    for w, h in zip(tokens, held):
        if not h:
            q = [b" ", *w, b"\n"]
            uni.update(q[1:])
            bi.update(zip(q, q[1:]))
            ctx.update(q[:-1])
    n, unit = sum(uni.values()), math.log10(sum(uni.values()) + 0.5 * (len(uni) + 1))
    out = []
    for (i, _), w, h in zip(rows, tokens, held):
        q = [b" ", *w, b"\n"]
        p = [(bi[u, v] + M.PRIOR * 10 ** (math.log10(uni[v] + 0.5) - unit)) / (ctx[u] + M.PRIOR) for u, v in zip(q, q[1:])]
        out.append((i, h, len(q) - 1, sum(uni[x] > 0 for x in q[1:]), n, sum(math.log10(uni[x] + 0.5) - unit for x in q[1:]), sum(map(math.log10, p))))
    return out


@pytest.mark.parametrize("shard", [3_000_000, 400])
def test_scores_equal_plain_model(spark, shard):
    rows = messy_rows() + [(i, f"alpha w{i % 7} the end w{i % 3}") for i in range(100, 160)]
    df = spark.createDataFrame([(i, t, "c", 3) for i, t in rows], "doc_id long, text string, word string, n int")
    got = sorted((tuple(r) for r in M.scores(df, shard).collect()), key=lambda r: (repr(r[:5]), round(r[5], 6), r[6]))
    want = sorted(plain_model(rows), key=lambda r: (repr(r[:5]), round(r[5], 6), r[6]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)
    assert np.allclose([r[6] for r in got], [r[6] for r in want], rtol=0.02)  # weights are quantised to 256 values


def test_hot_pairs_are_split_by_text(spark):
    import pickle

    import zstandard

    rows = [(i, f"of the {'x ' * (i % 50)}w{i % 7}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    plan, size = M.plan_shards(df, M.word_counts(df), 400), Counter()
    for r in M.pairs(df, plan).collect():
        size[r.shard] += int(pickle.loads(zstandard.decompress(r.pairs))[1].sum())
    assert max(size.values()) <= 800  # 900 texts hold the pair, 'x x' comes up 20,000 times
    got, want = sorted(tuple(r) for r in M.scores(df, 400).collect()), sorted(plain_model(rows))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)
    assert np.allclose([r[6] for r in got], [r[6] for r in want], rtol=0.02)


def test_empty_and_untrained(spark, nothing):
    assert M.scores(nothing).collect() == []
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    rows = M.scores(spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")).collect()
    assert len(rows) == 3 and all(r.train_tokens == 0 and r.n_known == 0 and r.held_out for r in rows)


def test_held_out_texts_are_likelier_than_by_unigrams(spark):
    from pyspark.sql import functions as F

    r = M.scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]
