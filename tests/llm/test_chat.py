import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from retentio.llm import chat as C

MARKS = st.lists(st.sampled_from(["\\", "<", "|", ">", "<|", "<|end|>\n", "<|turn|>", "<|text|>", "<\\|", "a", "é", "\n"]), max_size=12).map("".join)


@settings(max_examples=500, deadline=None)
@given(MARKS | st.text(max_size=20))
def test_escapes_are_reversible_and_leave_no_mark(text):
    assert C.unescape(C.escape(text)) == text
    assert "<|" not in C.escape(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(MARKS, MARKS), max_size=5))
def test_template_round_trip(turns):
    formatted = "".join(f"{C.TURN}{C.escape(r)}{C.TEXT}{C.escape(t)}{C.END}" for r, t in turns)
    assert list(C.parse(formatted)) == turns


LAYOUTS = [
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": [{"type": "text", "text": "b"}, {"type": "text", "text": "c"}]}]}, "messages", [("user", "a"), ("assistant", "bc")]),
    ({"id": 1, "conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}], "system": "s"}, "shared", [("system", "s"), ("user", "a"), ("assistant", "b")]),
    ({"instruction": "do", "input": "this", "output": "done"}, "instruction", [("user", "do\n\nthis"), ("assistant", "done")]),
    ({"instruction": "do", "input": "", "output": None}, "instruction", [("user", "do"), ("assistant", "")]),
    ({"history": [["q", "a"], ["r"]], "instruction": "do", "output": "done"}, "instruction with history", [("user", "q"), ("assistant", "a"), ("user", "r"), ("assistant", ""), ("user", "do"), ("assistant", "done")]),
    ({"prompt": "p", "response": 3}, "prompt and response", [("user", "p"), ("assistant", "3")]),
    ({"prompt": "p", "completion": True}, "prompt and completion", [("user", "p"), ("assistant", "true")]),
    ({"context": "c", "question": "q", "answer": "a"}, "question and answer", [("user", "c\n\nq"), ("assistant", "a")]),
    ({"dialog": ["a", "b", "c"]}, "dialog", [("user", "a"), ("assistant", "b"), ("user", "c")]),
    ({"role": "tool", "text": ""}, "turn", [("tool", "")]),
    ({"role": "tool", "content": "x"}, "turn with content", [("tool", "x")]),
    ({"messages": None, "prompt": "p", "response": "r"}, "prompt and response", [("user", "p"), ("assistant", "r")]),
    ({"other": 1}, "none", []),
    ({"messages": []}, "none", []),
]


def records(spark, rows):
    return spark.createDataFrame([(i, 0, json.dumps(r) if not isinstance(r, str | None) else r) for i, r in enumerate(rows)], "conv_id long, place long, record string")


def test_layouts_become_turns(spark):
    found = C.canonical(records(spark, [r for r, _, _ in LAYOUTS])).orderBy("conv_id", "part").collect()
    for i, (_, name, turns) in enumerate(LAYOUTS):
        mine = [r for r in found if r.conv_id == i]
        assert {r.layout for r in mine} == {name}, i
        assert [(r.role, r.text) for r in mine if r.part is not None] == turns, i


def test_fingerprints_follow_paths_not_values(spark):
    rows = [{"a": [{"b": 1}, {"c": "x"}]}, {"a": [{"c": "y", "b": 2}]}, {"a": [{"b": 1}]}, {"a": {"b": 1}}]
    marks = [r.fingerprint for r in C.canonical(records(spark, rows)).orderBy("conv_id").collect()]
    assert marks[0] == marks[1] and len(set(marks)) == 3
    assert set(C.paths(rows[0])) == {"a[]", "a[].b", "a[].c"}


def test_records_without_turns_are_listed(spark):
    turns = C.canonical(records(spark, [None, "{", "[1]", "7", json.dumps({"x": 1}), json.dumps({"prompt": "p", "response": "r"}), '{"dialog": ["\\ud800"]}']))
    assert sorted(r.conv_id for r in C.rejected(turns).collect()) == [0, 1, 2, 3, 4]
    assert turns.where("conv_id = 6").first().text == "?"


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", hashlib.md5((r[3] or "").encode()).hexdigest()))
        turns = [(r[2] or "", r[3] or "") for r in mine]
        loss = "".join(t for r, t in turns if r == "assistant")
        formatted = "".join(f"{C.TURN}{C.escape(r)}{C.TEXT}{C.escape(t)}{C.END}" for r, t in turns)
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted))
    return out


MESSY = [
    (1, 0, "user", "hello <|end|>\n\\ there"), (1, 1, "assistant", "<|turn|>assistant<|text|>"), (1, None, "system", "first"),
    (2, 5, None, None), (2, 5, "assistant", ""), (2, 5, "assistant", "tie"), (2, 5, "assistant", "tie"),
    (None, 0, "user", "no id"), (None, 1, "assistant", "answer"), (3, 0, "<|end|>\n", "é" * 3000), (4, 0, "assistant", "x" * 200_000),
    (-9, 0, "assistant", "日本  \U0001f600"),
] + [(7, k, ("user", "assistant")[k % 2], f"turn {k} " * 5) for k in range(400)]


@pytest.mark.parametrize("segment", [1, 500, C.SEGMENT])
def test_messy_conversations_read_back(spark, segment):
    df = spark.createDataFrame(MESSY, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("place", "record", "part", "task", "formatted")}).repartition(5)
    segments = C.format_turns(C.canonical(C.conversation_records(df)), segment)
    rows = {r.conv_id: tuple(r)[1:6] for r in C.digests(segments).collect()}
    assert rows == expected(MESSY)
    if segment == 1:
        assert segments.count() == len(MESSY)


def test_written_query_and_probe(spark, sf_dir):
    rows = C.op12_chat_format(spark, sf_dir).where("conv_id = -7").collect()
    want = expected([(-7, 0, "user", C.PROBE), (-7, 1, "assistant", C.PROBE)])[-7]
    assert [tuple(r)[1:] for r in rows] == [want]


def test_typed_columns_as_records(spark):
    df = spark.sql("SELECT 1L AS conv_id, 0L AS place, array(named_struct('from', 'human', 'value', 'hi')) AS conversations, CAST(NULL AS string) AS prompt")
    turns = C.canonical(df.select("conv_id", "place", C.record_of("conversations", "prompt").alias("record"))).collect()
    assert [(r.layout, r.role, r.text) for r in turns] == [("shared", "user", "hi")]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.digests(C.format_turns(C.canonical(C.conversation_records(empty)))).count() == 0
