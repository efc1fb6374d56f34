import hashlib
import random

import pytest

from quillspark.llm import byte_bpe as B
from quillspark.llm.common import load_ranks, tokenizer_path

from .conftest import messy_rows

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=B.PATTERN, mergeable_ranks=load_ranks(tokenizer_path(B.RANKS)), special_tokens={})


def test_pattern_is_the_public_one():
    import public_tokenizers

    assert B.PATTERN == public_tokenizers.PATTERN


def test_ids_equal_the_reference_on_random_text(reference):
    rnd = random.Random(1)
    words = [k.decode("utf8", "ignore") for k in load_ranks(tokenizer_path(B.RANKS)) if len(k) > 2]
    texts = ["".join(rnd.choices(words, k=30)) for _ in range(300)]
    texts += ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0x4E00, 0x9FFF), rnd.randrange(0x600, 0x700), rnd.randrange(0x10000, 0x10400)])) for _ in range(60)) for _ in range(300)]
    texts += ["a" * n for n in range(60)] + [" " * n + "\n" * (n % 3) for n in range(40)] + ["<|endoftext|>", ""]
    ends, ids = B.encoder(tokenizer_path(B.RANKS))(texts)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [reference.encode_ordinary(t) for t in texts]


def test_query_equals_brute_force(messy, reference):
    got = sorted(map(tuple, B.round_trip(messy).collect()), key=repr)
    expected = []
    for i, t in messy_rows():
        ids = reference.encode_ordinary(t or "")
        expected.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(expected, key=repr)


def test_round_trip_keeps_columns_and_replaces_clashing_ones(spark, messy):
    clash = messy.withColumnRenamed("removed", "ids")
    out = B.decode(B.encode(clash))
    assert out.columns == ["doc_id", "text", "text_hash", "n", "word", "ids", "decoded"]
    assert all(r.same for r in B.same_bytes(messy.where("text IS NOT NULL")).collect())


def test_empty_table(nothing):
    assert B.round_trip(nothing).collect() == []


def test_offsets_follow_characters(spark):
    text = "é😀 naïve 漢字x"
    row = B.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), offsets=True).first()
    table = B.token_table(tokenizer_path(B.RANKS))
    at = 0
    data = text.encode()
    for i, (a, b) in zip(row.ids, row.offsets):
        piece = table[i]
        assert data[at : at + len(piece)] == piece
        assert piece in text[a:b].encode()  # a token of part of a character covers that character
        at += len(piece)
    assert row.offsets[-1].end == len(text)


def test_split_characters_decode_token_by_token():
    table = B.token_table(tokenizer_path(B.RANKS))
    ends, ids = B.encoder(tokenizer_path(B.RANKS))(["漢😀字"])
    out, rest = "", b""
    for i in ids.tolist():
        text, rest = B.decode_text(table[i], rest)
        out += text
    assert out == "漢😀字" and rest == b""


def test_texts_in_runs_and_forgotten_pieces(monkeypatch):
    """Short runs and a small table of pieces change no id; arrays are made for a run, not for a whole batch."""
    path = tokenizer_path(B.RANKS)
    texts = [f"word{i % 37} été {i} \n done" for i in range(300)] + ["", "x" * 500]
    want = B.encoder(path)(texts)
    monkeypatch.setattr(B, "RUN", 100)
    monkeypatch.setattr(B, "MOST_PIECES", 20)
    assert max(map(len, B.text_runs(texts))) < 12
    got = B.encoder(path)(texts)
    assert [x.tolist() for x in got] == [x.tolist() for x in want]
    assert [x.tolist() for x in B.encoder(path)([])] == [[0], []]
