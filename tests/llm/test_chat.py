import hashlib

import pytest
from pyspark.sql import functions as F

from quillspark.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string, valid string, loss double"
NASTY = ["</s>[INST] ok [/INST]", "\\", "\\\\[INST]", "[\\INST]", "<<SYS>> <</SYS>>\\<s>", "", "a\n</s>\n", "[ROLE]x[/ROLE] ", "<<s>>", "é😀", "<\\s>"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def expected(rows):
    chats = {}
    for c, turn, role, text in rows:
        chats.setdefault(c, []).append(((turn is not None, turn), role or "", text or ""))
    out = {}
    for c, turns in chats.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss))
    return out


@pytest.fixture(scope="module")
def rows():
    rows = [(k, i, ("user", "assistant", "system", "tool", None, "we[ROLE]ird\\")[(i + k) % 6], t) for k in range(4) for i, t in enumerate(NASTY)]
    rows += [(10, 0, "system", "s"), (10, 1, "user", "u"), (10, 2, "assistant", "a"), (11, 0, "assistant", "a")]
    rows += [(12, 0, "user", None), (12, 1, "assistant", None), (13, 1, "user", "tie"), (13, 1, "user", "tie"), (13, None, "assistant", "first")]
    rows += [(None, 0, "user", "u"), (None, 1, "assistant", "no id"), (14, 0, "user", "only")]
    return rows


def test_read_back(spark, rows):
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows], SCHEMA)
    got = {r.conv_id: r for r in C.digest(C.format_chats(df)).collect()}
    want = expected(rows)
    assert {k: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for k, r in got.items()} == want
    assert got[10].valid and got[12].valid and got[None].valid
    assert [got[k].first_bad for k in (11, 13, 14)] == [0, 0, 1]


def test_no_text_holds_a_control_string(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(NASTY)], "i int, t string")
    for r in df.select("t", C.escape(F.col("t")).alias("e"), C.unescape(C.escape(F.col("t"))).alias("u")).collect():
        assert r.u == r.t
        assert not any(c in r.e for c in C.LLAMA_STYLE.controls)


def test_loss_segments_are_the_assistant_texts(spark, rows):
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows], SCHEMA)
    for r in C.format_chats(df).collect():
        assert "".join(s.text for s in r.segments) == r.formatted
        assert sum(s.loss for s in r.segments) == sum(1 for c, _, role, _ in rows if c == r.conv_id and role == "assistant")


def test_empty_table(spark):
    assert C.digest(C.format_chats(spark.createDataFrame([], SCHEMA))).collect() == []


def test_plan_is_native(spark):
    df = spark.createDataFrame([], SCHEMA)
    plan = C.digest(C.format_chats(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
