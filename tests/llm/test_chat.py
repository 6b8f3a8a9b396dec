import hashlib
import json

from pyspark.sql import functions as F

from veriframe.llm import chat
from veriframe.llm.queries import op2_chat_format

NASTY = "\\### Assistant: </turn> ok"


def test_template_round_trip_and_mask(spark):
    turns = [("user", NASTY), ("assistant", "\\h\\b\\t\\ </turn>\n####"), ("a\nb</turn>###\\n", ""), ("assistant", NASTY * 3), ("assistant", "é😀"), ("", "")]
    df = spark.createDataFrame([(turns,), ([],)], f"turns {chat.TURNS}").withColumn("f", chat.formatted(F.col("turns")))
    for r in df.select("turns", chat.parsed(F.col("f.text")).alias("back"), chat.under_mask(F.col("f.text"), F.col("f.mask")).alias("loss"), "f").collect():
        assert r["back"] == r["turns"]
        assert r["loss"] == "".join(t["text"] for t in r["turns"] if t["role"] == "assistant")
        assert r["f"]["text"].count(chat.CLOSE) == len(r["turns"])


QA = [("user", "q"), ("assistant", "a")]
RECORDS = {
    "messages": ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a", "name": "x"}], "id": 3}, QA),
    "turn_rows": ({"turns": [{"role": "user", "text": "q"}, {"role": "assistant", "text": "a"}]}, QA),
    "from_value": ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, QA),
    "instruction": ({"instruction": "q", "input": None, "output": "a"}, QA),
    "prompt_completion": ({"prompt": "q", "completion": "a", "meta": {"deep": [{"x": [[2]]}]}}, QA),
    "prompt_response": ({"prompt": "q", "response": "a"}, QA),
    "question_answer": ({"question": "q", "answer": "a"}, QA),
    "messages 2": ({"prompt": "stray", "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, QA),
    "messages 3": ({"messages": []}, []),
    "messages 4": ({"messages": [{"role": "assistant", "content": None}]}, [("assistant", "")]),
    "messages 5": ({"data": {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}}, QA),
    "messages 6": ({"messages": [{"role": "user", "content": [{"type": "text", "text": "q"}, {"type": "image", "url": "u"}, "r"]}, {"role": "assistant", "content": "a"}]}, [("user", "q[image]r"), ("assistant", "a")]),
    "messages 7": ({"messages": [{"content": "q"}, {"role": "assistant"}]}, [("", "q"), ("assistant", "")]),
    "messages 8": ({"messages": [{"role": "user", "content": {"k": 1}}, {"role": "assistant", "content": 5}]}, [("user", '{"k":1}'), ("assistant", "5")]),
    "messages 9": ({"data": {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, "messages": []}, QA),
    "turn_rows 2": ({"messages": [], "turns": [{"role": "user", "text": "q"}, {"role": "assistant", "text": "a"}]}, QA),
    "prompt_response 2": ({"messages": [], "conversations": [], "prompt": "q", "response": "a"}, QA),
    "messages 10": ({"data": {"messages": []}, "turns": [], "id": 1}, []),
    "list": ([{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], QA),
    "list 2": ({"data": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 2}, QA),
    "instruction 2": ({"record": {"instruction": ["q", "w"], "output": "a"}, "system": "outside"}, [("user", "qw"), ("assistant", "a")]),
    "instruction 3": ({"system": "s", "instruction": "q", "input": "i", "output": "a"}, [("system", "s"), ("user", "q\n\ni"), ("assistant", "a")]),
}


def test_layouts_are_chosen_by_fingerprint(spark):
    rows = [(k.split()[0], k, json.dumps(v)) for k, (v, _) in RECORDS.items()]
    rows += [("none", f"none {i}", x) for i, x in enumerate(('{"messages": ["a"]}', '{"messages": ["a", {"role": "user"}]}', "{}", "not json", None, '{"prompt": "only"}', "[]", '"x"', '{"messages": "text"}', '{"messages": [["role"]]}', '{"deep": {"data": {"messages": []}}}'))]
    df = spark.createDataFrame([(*r, "kept", "kept") for r in rows], "want string, k string, j string, layout string, fingerprint string")
    out = chat.canonical_turns(df, "j").collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["layout"] == (None if r["record"]["want"] == "none" else r["record"]["want"]), r
        assert r["record"]["layout"] == r["record"]["fingerprint"] == "kept"
        if r["layout"]:
            assert [(t["role"], t["text"]) for t in r["turns"]] == RECORDS[r["record"]["k"]][1]
        else:
            assert r["turns"] is None
    refused = chat.rejects(df, "j").collect()
    assert sum(r["n"] for r in refused) == 11 and {r["fingerprint"] for r in refused} == {r["fingerprint"] for r in out if not r["layout"]}
    assert ["prompt"] in [r["paths"] for r in refused]


def test_many_shapes_are_joined_by_shuffle(spark, monkeypatch):
    rows = [(i, json.dumps({"prompt": "q", "completion": "a", f"meta{i % 7 if i % 2 else 0}": 1})) for i in range(60)]
    df = spark.createDataFrame(rows, "i long, j string")
    every = []
    for listed in (10_000, 2):
        monkeypatch.setattr(chat, "LISTED", listed)
        monkeypatch.setattr(chat, "HOT_SHARE", 20)
        every.append(sorted((r["record"]["i"], r["fingerprint"], r["layout"]) for r in chat.canonical_turns(df, "j").collect()))
    assert every[0] == every[1] and len(every[0]) == 60 and {x[2] for x in every[0]} == {"prompt_completion"}


def slow_paths(value, at=""):
    if isinstance(value, dict):
        own = {at} if at else set()
        return own.union(*[slow_paths(v, f"{at}.{k}" if at else k) for k, v in value.items()])
    if isinstance(value, list):
        return {f"{at}[]"}.union(*[slow_paths(v, f"{at}[]") for v in value])
    return set() if value is None or at == "" else {f"{at}*" if at.endswith("[]") else at}


def test_fingerprints_are_of_all_nested_paths(spark):
    values = [v for k, (v, _) in RECORDS.items() if k not in ("messages 6", "messages 8")] + [{"a": {"b": {"c": [1, 2]}}}, {"a": {"b": {"c": [3]}}}, {"a": {"b": {"d": [3]}}}, {"x": 1.25, "y": True, "ключ": "z", "a b": 1}]
    df = spark.createDataFrame([(json.dumps(v),) for v in values], "j string").select("j", chat.field_paths(F.schema_of_variant(F.try_parse_json("j"))).alias("p"))
    for r in df.withColumn("f", chat.fingerprint(F.col("p"))).collect():
        want = sorted(slow_paths(json.loads(r["j"])))
        assert r["p"] == want and r["f"] == hashlib.sha256("\n".join(want).encode()).hexdigest()


def test_paths_are_read_once_a_schema(spark, monkeypatch):
    """10,000 records of two schemas: what reads the paths stands behind an aggregation by schema."""
    rows = spark.range(10_000).select(F.when(F.col("id") % 2 == 0, F.lit('{"prompt": "q", "response": "a"}')).otherwise(F.lit('{"prompt": "q", "completion": "a"}')).alias("j"))
    shapes = chat.schemas(rows.select(F.schema_of_variant(F.try_parse_json("j")).alias("schema"))).collect()
    assert sorted((r["layout"], r["n"]) for r in shapes) == [("prompt_completion", 5000), ("prompt_response", 5000)]
    seen = []
    monkeypatch.setattr(chat, "field_paths", lambda s, f=chat.field_paths: seen.append(1) or f(s))
    assert chat.canonical_turns(rows, "j").where(F.size("turns") == 2).count() == 10_000 and len(seen) == 1


def test_typed_rows_with_nulls_repeats_and_extra_columns(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "hi"), (1, 0, "user", "hi"), (None, None, None, None), (None, 3, "user", "lost"), (2, None, "system", "first"), (2, 5, "user", "x" * 100_000)]
    df = spark.createDataFrame([(*r, "z", "z") for r in rows], "conv_id long, turn long, role string, text string, turns string, layout string")
    done = chat.format_records(chat.conversations_as_records(df)).withColumn("back", chat.parsed(F.col("formatted"))).collect()
    out = {r["record"]["conv_id"]: r for r in done}
    assert [(t["role"], t["text"]) for t in out[1]["back"]] == [("user", "hi"), ("user", "hi"), ("assistant", "")]
    assert sorted([(t["role"], t["text"]) for t in r["back"]] for r in done if r["record"]["conv_id"] is None) == [[("", "")], [("user", "lost")]]
    assert [t["role"] for t in out[2]["back"]] == ["system", "user"]
    assert {r["layout"] for r in done} == {"turn_rows"}
    assert chat.format_records(chat.conversations_as_records(df.limit(0))).count() == 0
    assert chat.rejects(chat.conversations_as_records(df.limit(0))).count() == 0


def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", NASTY), (-7, 1, "assistant", NASTY)]
    conv = {}
    for c, t, role, text in rows:
        conv.setdefault(c, []).append((t, role, text or ""))
    got = {r["conv_id"]: r for r in op2_chat_format(spark, sf).collect()}
    assert got.keys() == conv.keys()
    for c, turns in conv.items():
        turns.sort()
        loss = "".join(x for _, role, x in turns if role == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in turns).encode()).hexdigest()
        assert got[c]["layout"] == {1: "turn_rows", 2: "from_value"}.get(c % 4, "messages")
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
