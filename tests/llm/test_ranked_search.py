import math
import re
from collections import Counter

import numpy as np
import pytest

from quillspark.llm import ranked_search as R

from .conftest import messy_rows, rows_of

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in WORD.findall(text or "")]


def brute(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, c) for i, c in bags if c]
    n_docs, length = len(bags), sum(sum(c.values()) for _, c in bags)
    df = Counter(t for _, c in bags for t in c)
    wanted = {}
    for item, t in items:
        wanted.setdefault(item, set()).update(terms(t))
    out = []
    for item, ts in wanted.items():
        scored = []
        for i, c in bags:
            m = 50 + (50 * sum(c.values()) * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if c[t])
            if s > 0:
                scored.append((-s, i is not None, i or 0))
        for rank, (s, known, i) in enumerate(sorted(scored)[:k], 1):
            out.append((item, rank, i if known else None, -s))
    return sorted(out, key=repr)


ITEMS = [("a", "alpha gamma délta"), ("b", "THE of und und"), ("c", None), ("d", ""), ("e", "unseen words"), ("f", "alpha x1 unseen the"), ("f", "tail"), (None, "omega beta"), ("a", "alpha gamma délta")]


@pytest.mark.parametrize("k", [1, 3, 50])
@pytest.mark.parametrize("block_bytes", [1 << 20, 20])
def test_equals_brute_force(spark, messy, k, block_bytes):
    items = spark.createDataFrame([(*r, 1) for r in ITEMS], "item_id string, text string, score int")
    assert rows_of(R.search(messy, items, k, block_bytes)) == brute(messy_rows(), ITEMS, k)


def test_accumulators_are_limited_and_exact(spark):
    """Skewed terms over many documents: the search stops making accumulators, and the result stays whole."""
    rng = np.random.default_rng(4)
    vocabulary = [f"t{i}" for i in range(300)]
    share = 1 / np.arange(1, 301)
    docs = [(i, " ".join(rng.choice(vocabulary, rng.integers(1, 60), p=share / share.sum()))) for i in range(1500)]
    items = [(str(j), " ".join(rng.choice(vocabulary, 15))) for j in range(20)] + [("copy", docs[7][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = R.search(frame, spark.createDataFrame(items, "item_id string, text string"), 5)
    assert rows_of(got) == brute(docs, items, 5)


def test_no_new_accumulators_after_the_bound():
    class Fake:
        doc_id = np.arange(6)
        owner = np.array([0, 1, 0, 1, 2, 3, 4, 5])
        impact = np.array([90, 80, 1, 1, 1, 1, 1, 1])
        starts = np.array([0, 2, 8])
        most = np.array([90, 1])

    best = R.Best(2)
    R.search_batch(Fake, np.array([0, 1]), np.array([10, 10]), best)
    assert best.doc.tolist() == [0, 1] and best.score.tolist() == [910, 810]


def test_empty_tables(spark, messy, nothing):
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    assert rows_of(R.search(nothing, items)) == [] and rows_of(R.search(messy, items.limit(0))) == []
