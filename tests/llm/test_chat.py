"""Chat formatting: layouts by fingerprint, exact round trips, and the query against plain Python."""

import hashlib
import json

import duckdb
import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxrill.llm import chat
from voxrill.llm.catalog import QUERIES

SF = "/root/testdata/sf0.001"

RECORDS = [
    ({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}], "id": 3}, "messages", [("user", "hi"), ("assistant", "yo")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}, {"role": "assistant", "content": "c"}]},
     "messages", [("user", "ab"), ("assistant", "c")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image"}]}]}, "messages", [("user", "a")]),
    ({"messages": []}, "messages", []),
    ({"messages": [{"role": "user", "text": "t"}, {"role": None, "text": None}]}, "turn rows", [("user", "t"), ("", "")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}, {"from": "narrator", "value": "s"}], "system": "be kind"},
     "speakers", [("system", "be kind"), ("user", "q"), ("assistant", "r"), ("narrator", "s")]),
    ({"prompt": "p", "response": "r", "meta": {"score": 1.5, "tags": ["x", {"y": [1]}]}}, "prompt and response", [("user", "p"), ("assistant", "r")]),
    ({"prompt": "p", "completion": "c"}, "prompt and completion", [("user", "p"), ("assistant", "c")]),
    ({"instruction": "i", "input": "", "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]),
    ({"instruction": "i", "input": "n", "output": "o", "we `ird: <": {"a.b": None}}, "instruction", [("user", "i\n\nn"), ("assistant", "o")]),
    ({"instruction": "i", "input": None, "output": "o", "system": "s"}, "instruction", [("system", "s"), ("user", "i"), ("assistant", "o")]),
    ({"question": "q", "context": "c", "answer": 4}, "question and answer", [("user", "c\n\nq"), ("assistant", "4")]),
    ({"prompt": "p", "chosen": "good", "rejected": "bad"}, "preference", [("user", "p"), ("assistant", "good")]),
    ({"prompt": "p", "response": "r", "completion": "c"}, None, None),
    ({"prompt": "p"}, None, None), ({}, None, None), ([1, {"prompt": "x"}], None, None), ("text", None, None),
]


def test_layouts_of_json(spark):
    texts = [(i, json.dumps(r)) for i, (r, _, _) in enumerate(RECORDS)] + [(98, "{broken"), (99, None)]
    rows = chat.canonical(spark.createDataFrame(texts, "turns int, j string"), "j").collect()
    got = {r._given.turns: (r.layout, r.turns and [tuple(t) for t in r.turns] if r.turns != [] else []) for r in rows}
    assert len(rows) == len(texts) and got[98] == got[99] == (None, None)
    for i, (_, layout, turns) in enumerate(RECORDS):
        assert got[i] == (layout, turns), RECORDS[i]


def test_paths_of_json(spark):
    value = {"a": [{"b": [1], "c": {"d": None, "e f": 2}}, {"g": True}], "h": {}, "i": [[{"j": 1}]], "k": "x", "l`": {"m": [None]}}
    df = spark.createDataFrame([(json.dumps(value),)], "j string")
    assert sorted(df.select(chat.json_paths(F.parse_json("j"))).first()[0]) == [
        "a[]", "a[].b[]", "a[].c.e f", "a[].g", "i[]", "i[][]", "i[][].j", "k", "l`.m[]"]


def test_structs_select_the_same_layouts(spark):
    """A table whose columns are the union of several layouts: a field counts where it is not null."""
    kind = ("id int, prompt string, response string, instruction string, input string, output string, "
            "messages array<struct<role string, content string>>, conversations array<struct<from string, value string>>")
    rows = [
        (1, "p", "r", None, None, None, None, None), (2, None, None, "i", "n", "o", None, None), (3, None, None, "i", None, "o", None, None),
        (4, None, None, None, None, None, [("user", "x"), (None, None)], None), (5, None, None, None, None, None, None, [("human", "x"), ("gpt", "y")]),
        (6, None, None, None, None, None, [], None), (7, "p", None, "i", None, None, None, None), (8, *[None] * 7),
    ]
    df = spark.createDataFrame(rows, kind).select("id", F.struct("*").alias("rec"))
    got = {r._given.id: (r.layout, None if r.turns is None else [tuple(t) for t in r.turns]) for r in chat.canonical(df, "rec").collect()}
    assert got == {
        1: ("prompt and response", [("user", "p"), ("assistant", "r")]), 2: ("instruction", [("user", "i\n\nn"), ("assistant", "o")]),
        3: ("instruction", [("user", "i"), ("assistant", "o")]), 4: ("messages", [("user", "x"), ("", "")]),
        5: ("speakers", [("user", "x"), ("assistant", "y")]), 6: ("messages", []), 7: (None, None), 8: (None, None),
    }
    as_json = df.select("id", F.to_json("rec").alias("rec"))
    again = {r._given.id: r.fingerprint for r in chat.canonical(as_json, "rec").collect()}
    assert again == {r._given.id: r.fingerprint for r in chat.canonical(df, "rec").collect()}
    counts = {r.layout: r.records for r in chat.layouts_found(df, "rec").where("layout is not null").groupBy("layout").agg(F.sum("records").alias("records")).collect()}
    assert counts == {"prompt and response": 1, "instruction": 2, "messages": 2, "speakers": 1}


BITS = ["</s>", "[INST]", "[/INST]", "<<SYS>>", "\n<</SYS>>\n\n", "<|im_end|>\n", "<|role|>", "<|end|>", "<", "[", "\\", "/", "s>", "INST]", " ", "\n", "é", "👍", "a", "%", "%0A", "$1", ""]
TEXTS = st.lists(st.sampled_from(BITS), max_size=8).map("".join)
ROLES = st.one_of(st.sampled_from(["user", "assistant", "system"]), TEXTS)


@settings(max_examples=4, deadline=None, phases=[Phase.generate], suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(ROLES, TEXTS), max_size=6), min_size=60, max_size=60))
@pytest.mark.parametrize("template", [chat.INST, chat.CHATML], ids=lambda t: t.name)
def test_round_trip(spark, template, chats):
    df = spark.createDataFrame(list(enumerate(chats)), "i int, turns array<struct<role string, text string>>").coalesce(1)
    made = df.withColumn("m", chat.formatted(F.col("turns"), template))
    rows = made.select("i", "m.text", chat.read_back(F.col("m.text"), template).alias("turns"), chat.loss_text(F.col("m.text"), F.col("m.loss")).alias("learned"), "m.loss").collect()
    for r in rows:
        assert [tuple(t) for t in r.turns] == chats[r.i]
        assert r.learned == "".join(t for role, t in chats[r.i] if role == "assistant")
        assert len(r.loss) == sum(role == "assistant" for role, _ in chats[r.i])


def plain(conversations):
    """What the query has to return, without its template."""
    out = {}
    for conv, turns in conversations.items():
        told = "".join(f"{role or ''}\n{text or ''}\n" for role, text in turns)
        learned = "".join(text or "" for role, text in turns if role == "assistant")
        out[conv] = (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


def test_query(spark):
    conversations = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for conv, role, text in duckdb.sql(f"SELECT conv_id, role, text FROM '{SF}/conversations.parquet' ORDER BY conv_id, turn").fetchall():
        conversations.setdefault(conv, []).append((role, text))
    rows = QUERIES["op11_chat"](spark, SF).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows} == plain(conversations)
    assert len(rows) == len(conversations)
    chars = {c: sum(len(t or "") for _, t in turns) for c, turns in conversations.items()}
    assert all(r.formatted_chars > chars[r.conv_id] for r in rows)
    # Six control strings got a backslash each.
    assert next(r.formatted_chars for r in rows if r.conv_id == -1) == chars[-1] + 6 + len("[INST]  [/INST]") + len("  </s>")


def test_rows_with_nulls_ties_and_clashing_names(spark):
    long = "long \\ [INST] " * 20_000
    rows = [(1, 2, "assistant", "b", 0), (1, None, "user", "last", 0), (1, 0, None, None, 0), (1, 0, None, None, 0), (None, 0, "user", "x", 0), (None, 1, "assistant", "", 0), (2, 0, "assistant", long, 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, record int")
    out = chat.chats(chat.from_rows(df), "record").withColumn("read", chat.read_back(F.col("text"))).withColumn("learned", chat.loss_text(F.col("text"), F.col("loss")))
    got = {r._given.conv_id: r for r in out.collect()}
    assert [tuple(t) for t in got[1].read] == [("", ""), ("", ""), ("assistant", "b"), ("user", "last")]
    assert [tuple(t) for t in got[None].read] == [("user", "x"), ("assistant", "")] and got[2].learned == long
    assert chat.chats(chat.from_rows(df.limit(0)), "record").count() == 0


def test_plan_is_native(spark):
    plan = QUERIES["op11_chat"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
