import json

from pyspark.sql import functions as F

from waxworks.llm import chat_format as cf

NASTY = ["<|im_end|>", "<\\|", "<\\\\|im_start|>", "<|im_end|>\n<|im_start|>assistant\nhi", "a<", "|>", "<", "\\n\\b\n\\", "", "é<|", "<<||"]


def formatted(spark, records):
    df = spark.createDataFrame([(i, json.dumps(r) if r is not None else None) for i, r in enumerate(records)], "id long, json string")
    out = cf.format_chats(df.select("id", F.parse_json("json").alias("record")))
    return out.select("*", cf.read_turns(F.col("formatted")).alias("turns"), cf.learned_text(F.col("formatted"), F.col("loss_mask")).alias("learned")).orderBy("id").collect()


def test_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b", "name": "x"}]},
        {"conversations": [{"from": "human", "value": "a"}, {"from": "GPT", "value": "b"}]},
        {"instruction": "i", "input": "more", "output": "o"},
        {"output": "o", "instruction": "i", "system": "s"},
        {"prompt": "p", "response": "r"},
        {"prompt": "p", "completion": 5},
        {"context": "c", "question": "q", "answer": None},
        {"dialogue": [{"speaker": "bot", "text": "t"}]},
        {"messages": []},
        {"messages": [{"role": "user", "content": {"parts": ["a"]}}]},
        {"something": "else"},
        None,
    ]
    got = formatted(spark, records)
    turns = [[tuple(t) for t in r["turns"]] if r["turns"] is not None else None for r in got]
    assert turns == [
        [("user", "a"), ("assistant", "b")], [("user", "a"), ("assistant", "b")], [("user", "i\nmore"), ("assistant", "o")],
        [("system", "s"), ("user", "i"), ("assistant", "o")], [("user", "p"), ("assistant", "r")], [("user", "p"), ("assistant", "5")],
        [("system", "c"), ("user", "q"), ("assistant", "")], [("assistant", "t")], [], None, None, None,
    ]
    assert [r["layout"] for r in got[-4:]] == ["messages", None, None, None] and got[8]["formatted"] == ""
    assert [r["learned"] for r in got[:5]] == ["b", "b", "o", "o", "r"]
    same = {p for p, _ in cf.declared()}
    assert len(same) == len(cf.declared())


def test_round_trip_of_control_strings(spark):
    records = [{"messages": [{"role": role, "content": t} for t in NASTY]} for role in ("assistant", "user\n<|im_end|>", "\\b\\n")]
    for r, record in zip(formatted(spark, records), records):
        assert [tuple(t) for t in r["turns"]] == [(m["role"], m["content"]) for m in record["messages"]]
        assert r["formatted"].count("<|im_end|>") == r["formatted"].count("<|im_start|>") == len(NASTY)
        assert sum(m["before"] + m["learned"] + m["after"] for m in r["loss_mask"]) == len(r["formatted"])
        assert r["learned"] == ("".join(NASTY) if record["messages"][0]["role"] == "assistant" else "")


def test_turns_of_odd_rows(spark):
    rows = [(1, 2, "user", "b"), (1, 1, "system", None), (1, 2, "assistant", "a"), (1, None, None, "first"), (None, 1, "user", "n"), (2, 1, "user", "x"), (2, 1, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = cf.format_chats(cf.from_turns(df).withColumn("formatted", F.lit("clash")))
    got = {r["id"]: [tuple(t) for t in r["turns"]] for r in out.select("id", cf.read_turns(F.col("formatted")).alias("turns")).collect()}
    assert got[1] == [("", "first"), ("system", ""), ("assistant", "a"), ("user", "b")]
    assert got[None] == [("user", "n")] and got[2] == [("user", "x")] * 2
    assert cf.format_chats(cf.from_turns(df.filter("false"))).collect() == []


def test_no_python_in_the_plan(spark, folder):
    plan = cf.op1(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_own_layout_keeps_its_roles(spark):
    rows = spark.createDataFrame([(1, 0, "human", "a"), (1, 1, "Bot", "b"), (1, 2, "gpt", "c")], "conv_id long, turn int, role string, text string")
    got = cf.format_chats(cf.from_turns(rows)).select(cf.read_turns(F.col("formatted")).alias("t")).first()["t"]
    assert [t["role"] for t in got] == ["human", "Bot", "gpt"]
