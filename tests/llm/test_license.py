import re

import pytest

from quillspark.llm import license_scan as L

from .conftest import rows_of

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


TEXTS = [
    "Licensed under the Apache License, Version 2.0.", "GNU General Public License GNU general-public license", "MIT License mit LICENSE cc-by", "This work is licensed under CC BY-NC 4.0.",
    None, "", "nothing here", "gnu general public", "the GNU General Public License, either version 3 of the License", "École MIT Licensé", "cc by cc by cc", "x " * 5000 + "apache license",
]
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def test_base_columns_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, labels int")
    got = L.report(L.scan(df))
    want = []
    for i, t in enumerate(TEXTS):
        w = words(t)
        places = [(k, label) for p, label in BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        starts = [k for k, _ in places]
        want.append((i, len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))))
    assert rows_of(got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) == sorted(want, key=repr)
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[0].labels == "apache,apache-2.0" and rows[3].labels == "cc-by,cc-by-nc" and rows[8].labels == "gpl,gpl-3.0"
    assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in rows.values())


@pytest.mark.parametrize(
    ("template", "text", "fits"),
    [
        ("a <<beginOptional>>b c<<endOptional>> d", "a d", True),
        ("a <<beginOptional>>b c<<endOptional>> d", "a b c d", True),
        ("a <<beginOptional>>b c<<endOptional>> d", "a b d", False),
        ("a <<var;min=1;max=2>> d", "a d", False),
        ("a <<var;min=1;max=2>> d", "a x d", True),
        ("a <<var;min=1;max=2>> d", "a d d", True),
        ("a <<var;min=1;max=2>> d", "a x y z d", False),
        ("a <<beginOptional>>b <<beginOptional>>c<<endOptional>><<endOptional>> d", "a b d", True),
        ("a <<beginOptional>>b <<beginOptional>>c<<endOptional>><<endOptional>> d", "a c d", False),
        ("<<beginOptional>>the<<endOptional>> a", "the a", True),
    ],
)
def test_templates(template, text, fits):
    machine = L.Automaton((L.Template("t", template),))
    w = text.encode().split()
    assert any((a, b) == (0, len(w)) for _, a, b in machine.places(w)) == fits


def test_random_texts_against_regular_expressions():
    import random

    rnd = random.Random(5)
    template = "a <<beginOptional>>b<<endOptional>> <<var;min=0;max=2>> c"
    machine = L.Automaton((L.Template("t", template),))
    rx = re.compile(r"a (?:b )?(?:\w ){0,2}c")
    for _ in range(300):
        w = rnd.choices("abcd", k=12)
        for start in range(12):
            m = [e for e in range(start, 12) if rx.fullmatch(" ".join(w[start : e + 1]))]
            got = [b - 1 for _, a, b in machine.places([x.encode() for x in w]) if a == start]
            assert got == m[-1:]


def test_refuses_templates_without_a_first_word_and_empty_tables(spark, nothing):
    with pytest.raises(ValueError):
        L.Automaton((L.Template("t", "<<var;min=0;max=1>> a"),))
    with pytest.raises(ValueError):
        L.Automaton((L.Template("t", "<<beginOptional>>a<<endOptional>>"),))
    assert L.report(L.scan(nothing)).collect() == []


def wording(label, whole=True):
    """A text that fits the template of ``label``: optional regions left out, free words ``someone``, first of the wordings."""
    text = next(t.text for t in L.TEMPLATES if t.label == label and t.whole == whole and not t.base)
    while "<<beginOptional>>" in text:
        text = re.sub(r"<<beginOptional>>(?:(?!<<beginOptional>>).)*?<<endOptional>>", " ", text, flags=re.S)
    return re.sub(r"<<var;match=([^|>]*)[^>]*>>", r"\1", re.sub(r"<<var;min=[^>]*>>", "someone", text))


WHOLE = [t.label for t in L.TEMPLATES if t.whole]


@pytest.mark.parametrize("label", WHOLE)
def test_one_changed_word_loses_the_label(label):
    machine = L.Automaton()
    found = lambda w: {machine.templates[k].label for k, _, _ in machine.places(w) if machine.templates[k].whole}
    w = [x.encode() for x in words(wording(label))]
    assert len(w) > 30 and found(w) == {label} and found([b"before", *w, b"after"]) == {label}
    for i, word in enumerate(w):
        if word != b"someone":
            assert label not in found([*w[:i], b"monday", *w[i + 1 :]]), (i, word)
            assert label not in found([*w[:i], *w[i + 1 :]]), (i, word)


def test_whole_texts_and_variants(spark):
    mit = wording("mit")
    rows = [
        "Copyright 2020\n" + mit.replace("BE LIABLE", "or anyone else be liable") + "\nend",
        mit.split("including without limitation")[0] + "but only on mondays",
        "creative commons attribution noncommercial license",
        "Creative Commons Attribution-ShareAlike 4.0 International License",
        "CC BY-NC-SA 4.0, not CC BY-ND",
        "Creative Commons Attribution 3.0 Unported License",
        wording("apache-2.0"),
        "This program is " + wording("gpl-3.0-or-later"),
        wording("bsd-3-clause").replace("Neither the name", "<p>3. Neither the name"),
        wording("bsd-3-clause").replace("Neither the name", "3. Neither the name"),
        "bsd is no license",
    ]
    got = L.report(L.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))).orderBy("doc_id").collect()
    assert [r.labels for r in got] == [
        "mit", "", "cc-by-nc", "cc-by-sa", "cc-by,cc-by-nc-sa,cc-by-nd", "cc-by", "apache,apache-2.0",
        "gpl,gpl-3.0,gpl-3.0-or-later", "", "bsd-3-clause", "",
    ]
    assert [r.text_labels for r in got] == ["mit", "", "", "", "", "", "apache-2.0", "gpl-3.0-or-later", "", "bsd-3-clause", ""]


@pytest.mark.parametrize(("text", "fits"), [("a b c e", True), ("a d e", True), ("a e", False), ("a b e", False), ("a b c d e", False), ("a b c", False)])
def test_listed_wordings(text, fits):
    machine = L.Automaton((L.Template("t", "a <<var;match=b c|d>> e"),))
    w = text.encode().split()
    assert any((a, b) == (0, len(w)) for _, a, b in machine.places(w)) == fits
