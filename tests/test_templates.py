"""Literal, sequential placeholder substitution and chat rendering."""


from quillspark.functions import templates as TP


def test_fill_is_literal_and_sequential(spark):
    df = spark.createDataFrame([("[P] @prompt [E] @essay [T] @trait", "p\\1 $1", "essay with @trait", "Ideas")],
                               "tpl string, prompt string, essay string, trait string")
    got = df.select(TP.retrieval_message("tpl", "prompt", "essay", "trait")).first()[0]
    # backslash and dollar survive; text inserted earlier is scanned by later placeholders
    assert got == "[P] p\\1 $1 [E] essay with Ideas [T] Ideas"


def test_instruction_strips_and_null_gives_null(spark):
    df = spark.createDataFrame([("@prompt|@essay", "  P \n", "\tE  "), ("@prompt|@essay", None, "E")],
                               "msg_user_instruction_template string, prompt string, essay string")
    got = [r[0] for r in df.select(TP.instruction()).collect()]
    assert got == ["P|E", None]


def test_render_formats(spark):
    df = spark.createDataFrame([("S", "U", "A", "U2")], "msg_system string, msg_user_retrieval string, "
                               "msg_assistant_retrieval string, msg_user_score string")
    r = df.select(TP.render_retrieval("msg_system", "msg_user_retrieval"), TP.render_two_turn(),
                  TP.render_single("msg_system", "msg_user_retrieval"),
                  TP.render_inst_chat(TP.messages_two_turn())).first()
    assert r[0] == "<s>[INST] <<SYS>>\nS\n<</SYS>>\n\nU [/INST]"
    assert r[1] == "<s>[INST] <<SYS>>\nS\n<</SYS>>\n\nU [/INST] A </s></s>[INST] U2 [/INST]"
    assert r[2] == "[INST] <<SYS>>\nS\n<</SYS>>\n\nU [/INST]"
    assert r[3] == "<s>[INST] S\nU [/INST]A</s>[INST] U2 [/INST]"


def test_conversation_prompt_chunks_equal_message_list(spark):
    from quillspark.operators.chat import conversation_messages, conversation_prompts
    from quillspark.sources.tables import read_table

    turns = read_table(spark, "/root/testdata/sf0.01", "conversations")
    a = {r[0]: r[1] for r in conversation_messages(turns).select("conv_id", TP.render_inst_chat("messages")).collect()}
    b = {r[0]: r[1] for r in conversation_prompts(turns, chunk_turns=2).collect()}
    c = {r[0]: r[1] for r in conversation_prompts(turns).collect()}
    assert a == b == c and len(a) > 50


def test_conversation_messages_chunking_keeps_order(spark):
    from quillspark.operators.chat import conversation_messages
    from quillspark.sources.tables import read_table

    turns = read_table(spark, "/root/testdata/sf0.01", "conversations")
    a = {r[0]: [tuple(m) for m in r[1]] for r in conversation_messages(turns, chunk_turns=1).collect()}
    b = {r[0]: [tuple(m) for m in r[1]] for r in conversation_messages(turns).collect()}
    exp = {}
    for r in sorted(turns.collect(), key=lambda r: (r["conv_id"], r["turn"])):
        exp.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert a == b == exp
