from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import quality_rules as Q
from quillspark.llm import text_stats as T
from quillspark.llm import weak_labels as W

from .conftest import messy_rows, rows_of

SF = "/root/testdata/sf0.01"


def plain_counts(text):
    ws = " \t\n\x0b\x0c\r"
    words, word = [], ""
    for c in (text or "") + " ":
        if c in ws:
            words += [word] if word else []
            word = ""
        else:
            word += c
    lines = [x for x in (text or "").split("\n") if x.strip(ws)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(grams)
    covered = {j for i, g in enumerate(grams) if many[g] > 1 for j in (i, i + 1, i + 2)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_base_counts(messy):
    got = Q.apply_rules(messy, []).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = []
    for i, t in messy_rows():
        c = plain_counts(t)
        want.append((i, *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    assert rows_of(got) == sorted(want, key=repr)


def test_repeat_words_overlap():
    assert T.repeat_words(b"a a a a".split()) == 4
    assert T.repeat_words(b"a b c x a b c".split()) == 6
    assert T.repeat_words(b"a b".split()) == 0


def test_rules_find_a_planted_conjunction():
    rng = np.random.default_rng(0)
    x, y = rng.random(4000), rng.random(4000)
    bad = (x > 0.7) & (y < 0.3) | (y > 0.95)
    rules = Q.learn({"x": x, "y": y}, bad)
    hit = np.zeros(4000, bool)
    for r in rules:
        hit |= Q.covers(r, {"x": x, "y": y}, np.ones(4000, bool))
    assert (hit == bad).mean() > 0.97 and len(rules) >= 2


def test_rules_as_case_expression_equal_the_list(spark):
    rng = np.random.default_rng(1)
    x, y = rng.random(500), rng.random(500)
    rules = [(Q.Condition("x", True, 0.8), Q.Condition("y", False, 0.5)), (Q.Condition("y", True, 0.9),)]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    got = [r.k for r in df.select(Q.verdict(rules).alias("k")).collect()]
    bad = (x >= 0.8) & (y <= 0.5) | (y >= 0.9)
    assert got == (~bad).tolist()
    assert df.select(Q.verdict([]).alias("k")).where("NOT k").count() == 0


def test_no_rules_without_two_classes(spark, messy, nothing):
    assert Q.learn({"x": np.ones(5)}, np.zeros(5, bool)) == [] and Q.learn({"x": np.zeros(0)}, np.zeros(0, bool)) == []
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    assert Q.fit(messy, labels) == [] and Q.fit(nothing, labels.limit(0)) == []
    assert Q.apply_rules(nothing, []).collect() == []


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    train, test = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    judged = Q.apply_rules(docs, Q.fit(docs, train)).join(test, "doc_id").where("NOT base_failed")
    right = judged.agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int"))).first()[0]
    clean_lost = judged.where("quality = 1 AND NOT kept").count()
    assert right > 0.95 and clean_lost <= 2


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(2)
    n, k = 20_000, len(W.LABELLERS)
    good = rng.random(n) < 0.85
    votes = np.full((n, k), W.NONE)
    for j in range(k):
        votes[~good & (rng.random(n) < 0.35), j] = W.BAD
        votes[good & (rng.random(n) < 0.0005), j] = W.BAD
    model = W.fit_labels(votes, np.ones(n))
    assert abs(model.good - 0.85) < 0.03
    assert np.abs(model.on_bad[:, W.BAD] - 0.35).max() < 0.06
    assert ((model.posterior(votes) > 0.5) == good).mean() > 0.97


@pytest.mark.parametrize("wrong", [0.05, 0.1, 0.2])
def test_a_labeller_that_is_often_wrong(wrong):
    """One labeller cries on 5, 10, 20 % of the good documents: its error is found, and they aren't rejected."""
    rng = np.random.default_rng(2)
    n, k = 20_000, len(W.LABELLERS)
    good = rng.random(n) < 0.85
    votes = np.full((n, k), W.NONE)
    for j in range(k):
        votes[~good & (rng.random(n) < 0.35), j] = W.BAD
        votes[good & (rng.random(n) < (wrong if j == 3 else 0.0005)), j] = W.BAD
    model = W.fit_labels(votes, np.ones(n))
    kept = model.posterior(votes) > 0.5
    assert abs(model.on_good[3, W.BAD] - wrong) < 0.01 and abs(model.good - 0.85) < 0.03
    assert (good & ~kept).sum() < 0.01 * good.sum() and (~good & kept).sum() < 0.05 * (~good).sum()


def test_faults_that_exclude_each_other():
    """Three kinds of fault, each seen by two labellers of its own, one of them not always: alarms are believed."""
    rng = np.random.default_rng(3)
    n, k = 20_000, len(W.LABELLERS)
    kind = rng.choice(4, n, p=[0.85, 0.05, 0.05, 0.05])
    votes = np.full((n, k), W.NONE)
    for f in (1, 2, 3):
        votes[kind == f, 2 * f] = W.BAD
        votes[(kind == f) & (rng.random(n) < 0.5), 2 * f + 1] = W.BAD
    votes[(kind == 0) & (rng.random(n) < 0.001), 0] = W.BAD
    model = W.fit_labels(votes, np.ones(n))
    assert len(model.kinds) == 3 and ((model.posterior(votes) > 0.5) == (kind == 0)).mean() > 0.998


def test_silence_of_a_labeller_that_abstains_is_no_evidence():
    votes = np.array([[W.BAD, W.NONE], [W.NONE, W.GOOD], [W.NONE, W.NONE]])
    model = W.fit_labels(votes, np.array([50.0, 500.0, 5.0]))
    p = model.posterior(votes)
    assert p[0] < 0.5 < 0.9 < p[2] and W.fit_labels(votes[:0], np.zeros(0)).posterior(votes[:0]).tolist() == []


def test_patterns_round_trip():
    votes = np.random.default_rng(3).integers(0, 3, (50, len(W.LABELLERS)))
    codes = np.array([int("".join(map(str, v)), 3) for v in votes])
    assert (W.votes_of(codes) == votes).all()


@pytest.fixture(scope="module")
def scorer(spark):
    return W.fit(spark.read.parquet(f"{SF}/documents.parquet"))


def test_classifier_against_labels(spark, scorer):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    judged = W.classify(docs, scorer).join(labels, "doc_id")
    assert judged.where("quality = 1 AND NOT kept").count() <= 2
    assert judged.where("quality = 0 AND kept").count() <= 0.1 * judged.where("quality = 0").count()


def test_keep_good_keeps_rows_and_columns(messy, nothing, scorer):
    judged = W.classify(messy, scorer)
    assert judged.count() == messy.count()
    kept = W.keep_good(messy, scorer)
    assert kept.columns == messy.columns and kept.count() == judged.where("kept").count()
    assert W.keep_good(nothing, scorer).collect() == [] and W.keep_good(nothing).collect() == []
    assert W.classify(nothing, W.fit(nothing)).collect() == []
