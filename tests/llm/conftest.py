"""Small tables that hold the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

import pytest

WORDS = ["alpha", "Beta", "gamma", "délta", "the", "of", "und", "x1", "|", "done.", "Ünder", "end,"]


def prose(rnd, n):
    return " ".join(rnd.choices(WORDS, k=n))


def messy_rows(seed=3):
    rnd = random.Random(seed)
    base = [prose(rnd, rnd.randrange(30, 90)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(20, base[0]), (21, base[1] + " tail"), (22, base[2].replace("alpha", "omega", 1))]  # copies and near copies
    rows += [(30, None), (31, ""), (32, " \n\t\n"), (33, "one"), (34, "\x00\x1f\x85 odd spaces here \U0001f600")]
    rows += [(None, base[3]), (None, None), (40, base[4]), (40, base[4]), (41, base[5]), (41, base[6] + " other")]  # repeated ids
    rows += [(50, "\n".join([base[7], base[8], base[7], "", base[9]])), (51, prose(rnd, 6000)), (52, "word " * 3000)]
    return rows


@pytest.fixture(scope="session")
def messy(spark):
    rows = [(i, t, "l", "s", 1.5, "k") for i, t in messy_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, text_hash string, removed string, n double, word string")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, text_hash string, removed string, n double, word string")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)
