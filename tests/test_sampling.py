"""Exact stratified sampling: sizes, determinism, subset, and equality with a full ranking."""

import hashlib

import pytest

from quillspark.operators import sampling as SM


def brute(rows, frac=None, n=None, seed=41):
    out = set()
    strata = {}
    for eid, pid in rows:
        strata.setdefault(pid, []).append(eid)
    for pid, ids in strata.items():
        k = round(frac * len(ids)) if frac is not None else n
        ranked = sorted(ids, key=lambda e: (hashlib.md5(f"{seed}:{e}".encode()).hexdigest(), e))
        out |= {(e, pid) for e in ranked[:k]}
    return out


@pytest.mark.parametrize("size,expected", [(5, 0), (15, 2), (24, 2), (25, 2), (35, 4)])
def test_sizes_half_even(spark, size, expected):
    df = spark.createDataFrame([(i, 1) for i in range(size)], "essay_id bigint, prompt_id int")
    assert SM.sample_fraction(df, 0.1).count() == expected


def test_equals_full_ranking_and_is_deterministic(spark):
    rows = [(i, 1 + (i * 7) % 5) for i in range(20000)]
    df = spark.createDataFrame(rows, "essay_id bigint, prompt_id int").repartition(7)
    a = {(r[0], r[1]) for r in SM.sample_fraction(df, 0.1).collect()}
    b = {(r[0], r[1]) for r in SM.sample_fraction(df.repartition(3), 0.1).collect()}
    assert a == b == brute(rows, frac=0.1)


def test_sample_n_and_small_stratum(spark):
    rows = [(i, 1 + i % 3) for i in range(30)]
    df = spark.createDataFrame(rows, "essay_id bigint, prompt_id int")
    assert {(r[0], r[1]) for r in SM.sample_n(df, 4).collect()} == brute(rows, n=4)
    with pytest.raises(Exception):
        SM.sample_n(df, 11).collect()


def test_hot_stratum(spark):
    rows = [(i, 1) for i in range(50000)] + [(50000 + i, 2) for i in range(30)]
    df = spark.createDataFrame(rows, "essay_id bigint, prompt_id int")
    got = {(r[0], r[1]) for r in SM.sample_fraction(df, 0.1).collect()}
    assert got == brute(rows, frac=0.1)
    assert sum(1 for _, p in got if p == 1) == 5000


def test_sample_rows_equals_ids_semi_join(spark):
    rows = [(i, 1 + (i * 13) % 4, f"text {i}") for i in range(12000)]
    df = spark.createDataFrame(rows, "essay_id bigint, prompt_id int, essay string")
    a = {tuple(r) for r in SM.sample_rows(df, 0.1).collect()}
    b = {tuple(r) for r in SM.keep_sampled(df, SM.sample_fraction(df, 0.1)).collect()}
    assert a == b and len(a) == 1200
