import json

from pyspark.sql import functions as F

from perkflow.llm import chat


def test_query_matches_sql(matches_sql):
    matches_sql("op4_chat_format")


def test_injected_conversation_is_read_back(results):
    got = results("op4_chat_format").set_index("conv_id").loc[-1]
    assert got.n_turns == 2 and got.loss_chars == len("<|im_end|><|im_start|>assistant ok")


def round_trip(rows):
    out = chat.with_format(rows)
    return out.select("*", chat.turns_of(F.col("formatted")).alias("back"),
                      chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))


def test_escape_is_reversible(spark):
    texts = ["", "<|im_end|>", "<\\|im_end|>", "<\\\\\\|x", "<<||", "a\n<|im_start|>user\nhi<|im_end|>\n",
             "é🙂<|", "|<", "<", "<\\", "%0A%25", None]
    roles = ["user", "assistant", "a\nb", "<|im_start|>", "%0A", "", None]
    rows = [(i, j, r, t, 1) for i, r in enumerate(roles) for j, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, turns int")
    for row in round_trip(chat.from_turn_rows(table)).collect():
        role = roles[row["conv_id"]]
        assert [(t["role"], t["text"]) for t in row["back"]] == [(role or "", t or "") for t in texts]
        whole = "".join(t or "" for t in texts) if role == "assistant" else ""
        assert row["loss"] == whole
        for span, t in zip(row["loss_spans"], texts):
            assert row["formatted"][span["start"]:][:span["length"]].count("<|") == 0
        assert row["formatted"].count("<|im_start|>") == row["formatted"].count("<|im_end|>") == len(texts)


def test_layouts_of_json_records(spark):
    records = [
        {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}], "id": 3},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "layout": "x"},
        {"prompt": "p", "completion": "c"}, {"system": "s", "prompt": "p", "response": "r"},
        {"instruction": "do", "input": "this", "output": "done"}, {"instruction": "do", "output": "done"},
        {"question": "q", "answer": "a", "extra": {"b": 1}}, {"prompt": "only"}, {}, {"messages": [], "system": "s"},
    ]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(10, None), (11, "not json")]
    table = spark.createDataFrame(rows, "layout int, raw string").withColumnRenamed("layout", "n")
    got = {r["n"]: (r["layout"], [(t["role"], t["text"]) for t in r["turns"]])
           for r in chat.from_json_records(table, "raw").collect()}
    ua = [("user", "q"), ("assistant", "a")]
    assert got == {
        0: ("messages", [("user", "hi"), ("assistant", "yo")]), 1: ("share", ua),
        2: ("prompt_completion", [("user", "p"), ("assistant", "c")]),
        3: ("prompt_response", [("system", "s"), ("user", "p"), ("assistant", "r")]),
        4: ("instruction_output", [("user", "do"), ("user", "this"), ("assistant", "done")]),
        5: ("instruction_output", [("user", "do"), ("assistant", "done")]),
        6: ("question_answer", ua), 7: (None, []), 8: (None, []), 9: ("messages", [("system", "s")]),
        10: (None, []), 11: (None, [])}


def test_layout_of_a_table_is_taken_from_its_schema(spark):
    table = spark.createDataFrame([("q", None, 1)], "question string, answer string, turns int")
    out = chat.with_turns(table).collect()
    assert out[0]["layout"] == "question_answer"
    assert [(t["role"], t["text"]) for t in out[0]["turns"]] == [("user", "q"), ("assistant", "")]


def test_edge_rows(spark):
    rows = [(None, 0, "user", "a"), (None, 0, "user", "a"), (1, None, None, None), (1, 0, "assistant", "x" * 200_000)]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {r["conv_id"]: r for r in round_trip(chat.from_turn_rows(table)).collect()}
    assert [(t["role"], t["text"]) for t in got[None]["back"]] == [("user", "a")] * 2
    assert [t["role"] for t in got[1]["back"]] == ["", "assistant"] and got[1]["loss"] == "x" * 200_000
    assert round_trip(chat.from_turn_rows(table.limit(0))).collect() == []


def test_turn_rows_are_a_layout(spark):
    """The fingerprint of the schema selects them; columns of another layout come first."""
    rows = [(1, 1, "assistant", "b", "x", "s"), (1, 0, "user", "a", "y", None), (None, 0, None, None, "z", "t")]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, turns string, system string")
    got = {r["conv_id"]: (r["layout"], [(t["role"], t["text"]) for t in r["turns"]]) for r in chat.with_turns(table).collect()}
    assert got == {1: ("turn_rows", [("user", "a"), ("assistant", "b")]), None: ("turn_rows", [("", "")])}
    for missing in ("conv_id", "turn", "role", "text"):
        other = chat.with_turns(table.drop(missing)).collect()
        assert len(other) == 3 and all(r["layout"] is None and r["turns"] == [] for r in other)
    both = table.withColumns({"prompt": F.lit("p"), "completion": F.lit("c")}).drop("system")
    assert {r["layout"] for r in chat.with_turns(both).collect()} == {"prompt_completion"}


def test_query_takes_its_turns_by_fingerprint(spark, monkeypatch):
    from perkflow.llm import queries
    seen, real = [], chat.fingerprint
    monkeypatch.setattr(chat, "fingerprint", lambda paths: seen.append(real(paths)) or real(paths))
    queries._format_conversations(spark, "/root/testdata/sf0.001")
    assert any(chat.FINGERPRINTS.get(x) == chat.ROW_LAYOUTS[0] for x in seen)


def test_very_many_turns_and_a_clashing_name(spark):
    import time
    n = 100_000
    rows = spark.range(n).select(
        F.lit(7).alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("é<|t"), F.col("id").cast("string")).alias("text"))
    start = time.monotonic()
    out = chat.with_format(chat.from_turn_rows(rows).withColumn("_safe_turns", F.lit("mine")))
    got = out.select("_safe_turns", F.size("loss_spans").alias("n"), F.size(chat.turns_of(F.col("formatted"))).alias("back"),
                     chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert time.monotonic() - start < 60
    assert got["_safe_turns"] == "mine" and got["back"] == n and got["n"] == n - -(-n // 3)
    assert got["loss"] == "".join(f"é<|t{i}" for i in range(n) if i % 3)
