"""Exact quantiles equal numpy's linear interpolation, for few and for many distinct values."""

import random

import numpy as np
import pytest

from quillspark.operators.quantiles import exact_quantiles


@pytest.mark.parametrize("buckets", [1, 4, 64])
def test_matches_numpy(spark, buckets):
    rnd = random.Random(3)
    rows = []
    for g in range(1, 6):
        n = [1, 2, 7, 500, 3000][g - 1]
        for _ in range(n):
            v = rnd.random() * 10 if g != 4 else rnd.choice([1.0, 2.5, 2.5, 7.0])
            rows.append((g, v))
        rows.append((g, None))
    rows.append((6, None))
    df = spark.createDataFrame(rows, "g int, v double").repartition(5)
    got = {r["g"]: (r["n"], r["q_0"], r["q_1"], r["q_2"]) for r in exact_quantiles(df, "g", "v", [0.25, 0.5, 0.75], n_buckets=buckets).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    for g in got:
        xs = np.array([v for gg, v in rows if gg == g and v is not None])
        exp = np.quantile(xs, [0.25, 0.5, 0.75])
        assert got[g][0] == len(xs)
        assert list(got[g][1:]) == pytest.approx(list(exp), abs=1e-12)
