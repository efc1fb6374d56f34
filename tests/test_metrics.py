"""Kappa and tau-b against brute-force definitions."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from quillspark import config as C
from quillspark.operators import metrics as M


def kappa_matrix(y1, y2, labels):
    """Quadratic weighted kappa from the confusion matrix (the textbook definition)."""
    idx = {v: i for i, v in enumerate(labels)}
    k = len(labels)
    cm = np.zeros((k, k))
    for a, b in zip(y1, y2):
        if a in idx and b in idx:
            cm[idx[a], idx[b]] += 1
    n = cm.sum()
    expected = np.outer(cm.sum(axis=1), cm.sum(axis=0)) / n
    w = np.array([[(i - j) ** 2 for j in range(k)] for i in range(k)], dtype=float)
    return 1 - (w * cm).sum() / (w * expected).sum()


def tau_b(x, y):
    n = len(x)
    s = 0
    for i in range(n):
        for j in range(i + 1, n):
            s += np.sign(x[i] - x[j]) * np.sign(y[i] - y[j])
    tot = n * (n - 1) / 2
    tx = sum(c * (c - 1) / 2 for c in pd.Series(x).value_counts())
    ty = sum(c * (c - 1) / 2 for c in pd.Series(y).value_counts())
    if tot == tx or tot == ty:
        return None
    return max(-1.0, min(1.0, s / math.sqrt(tot - tx) / math.sqrt(tot - ty)))


def make(spark, rows):
    return spark.createDataFrame(rows, "prompt_id int, y1 bigint, y2 bigint")


@pytest.fixture(scope="module")
def rated(spark):
    rnd = random.Random(5)
    rows = []
    for pid, (lo, hi) in C.ASAP_SCORE_RANGES.items():
        for _ in range(rnd.randint(20, 60)):
            a = rnd.randint(lo, hi)
            b = min(hi, max(lo, a + rnd.randint(-2, 2)))
            rows.append((pid, a, b))
    rows.append((1, 0, 5))  # out of domain for prompt 1: ignored by kappa
    return rows


def test_qwk_matches_matrix_definition(spark, rated):
    got = {r["prompt_id"]: r["qwk"] for r in M.qwk(make(spark, rated), spark, "y1", "y2", C.ASAP).collect()}
    for pid, (lo, hi) in C.ASAP_SCORE_RANGES.items():
        ys = [(a, b) for p, a, b in rated if p == pid]
        exp = kappa_matrix([a for a, _ in ys], [b for _, b in ys], list(range(lo, hi + 1)))
        assert got[pid] == pytest.approx(round(exp, 3), abs=1e-9)


def test_qwk_properties(spark, rated):
    same = M.qwk(make(spark, [(p, a, a) for p, a, _ in rated]), spark, "y1", "y2", C.ASAP).collect()
    assert all(r["qwk"] == 1.0 for r in same)
    fwd = {r[0]: r[2] for r in M.qwk(make(spark, rated), spark, "y1", "y2", C.ASAP).collect()}
    rev = {r[0]: r[2] for r in M.qwk(make(spark, [(p, b, a) for p, a, b in rated]), spark, "y1", "y2", C.ASAP).collect()}
    assert fwd == rev
    const = M.qwk(make(spark, [(3, 1, 1), (3, 1, 1)]), spark, "y1", "y2", C.ASAP).collect()
    assert const[0]["qwk"] is None


def test_ordinal_qwk(spark):
    rows = [(1, "low", "low"), (1, "medium", "high"), (1, "high", "high"), (1, "medium", "medium"), (1, "low", "medium")]
    df = spark.createDataFrame(rows, "prompt_id int, y1 string, y2 string")
    got = M.qwk(df, spark, "y1", "y2", C.TOEFL).first()["qwk"]
    lab = {"low": 0, "medium": 1, "high": 2}
    exp = kappa_matrix([lab[a] for _, a, _ in rows], [lab[b] for _, _, b in rows], [0, 1, 2])
    assert got == round(exp, 3)


def test_macro_average_uses_rounded_values(spark):
    per = spark.createDataFrame([(1, 10, 0.1234), (2, 10, 0.4566)], "prompt_id int, n bigint, qwk double")
    per = per.selectExpr("prompt_id", "n", "bround(qwk, 3) as qwk")
    rep = {r["prompt_id"]: r["qwk"] for r in M.macro_report(per).collect()}
    assert rep["average"] == round((0.123 + 0.457) / 2, 3)
    per2 = spark.createDataFrame([(1, 10, 0.5), (2, 10, None)], "prompt_id int, n bigint, qwk double")
    assert {r["prompt_id"]: r["qwk"] for r in M.macro_report(per2).collect()}["average"] is None


def test_tau_b_matches_pairwise(spark, rated):
    got = {r["prompt_id"]: r["kendall_tau"] for r in M.kendall_tau_b(make(spark, rated), "y1", "y2").collect()}
    for pid in C.ASAP_SCORE_RANGES:
        ys = [(a, b) for p, a, b in rated if p == pid]
        exp = tau_b([a for a, _ in ys], [b for _, b in ys])
        assert got[pid] == pytest.approx(round(exp, 3), abs=1e-9)


def test_tau_b_all_tied_is_null(spark):
    got = M.kendall_tau_b(make(spark, [(1, 3, 1), (1, 3, 2), (1, 3, 3)]), "y1", "y2").first()
    assert got["kendall_tau"] is None
