import json

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import chat_format as C

PIECE = st.sampled_from(["\\", "<", "s>", "/", "</s>", "<s>", "[INST]", "[/INST]", "INST]", "[", "a", "\n", "é", "\\\\<s>"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(PIECE, max_size=4).map("".join), st.lists(PIECE, max_size=8).map("".join)), max_size=5))
def test_round_trip(turns):
    text, mask = C.format_turns(turns, learned=tuple({r for r, _ in turns}))
    assert C.read_turns(text) == turns
    assert [C.unescape(text[a:b]) for a, b in mask] == [t for _, t in turns]
    assert text.count("[INST]") == len(turns) == text.count("</s>")


def test_layouts(spark):
    hello = [("user", "hi"), ("assistant", "yo")]
    cases = [
        ({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}], "id": 4}, "messages", hello),
        ({"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]}, "conversations", hello),
        ({"instruction": "hi", "input": "", "output": "yo"}, "instruction", hello),
        ({"instruction": "a", "input": "b", "output": "c", "system": "s"}, "instruction", [("system", "s"), ("user", "a\n\nb"), ("assistant", "c")]),
        ({"prompt": "hi", "response": "yo", "meta": {"x": [1]}}, "prompt-response", hello),
        ({"prompt": "hi", "completion": "yo"}, "prompt-completion", hello),
        ({"question": "hi", "answer": {"a": 1}}, None, None),
        ({"messages": []}, "messages", []),
        ({"foo": 1}, None, None),
    ]
    rows = [(i, json.dumps(r), "x") for i, (r, _, _) in enumerate(cases)] + [(99, None, "x"), (98, "[1]", "x"), (97, "{", "x")]
    got = {r.record_id: r for r in C.format_records(spark.createDataFrame(rows, "record_id long, record string, mapping string")).collect()}
    for i, (_, name, turns) in enumerate(cases):
        assert got[i].mapping == name
        if turns is not None:
            assert C.read_turns(got[i].formatted) == turns
        else:
            assert got[i].reason == "no mapping" and got[i].fingerprint
    assert all(got[i].reason == "no JSON object" for i in (97, 98, 99))
    assert got[2].fingerprint != got[3].fingerprint


def test_conversation_table(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, None, None), (None, 5, "assistant", "</s>"), (3, 0, "assistant", "y"), (3, 0, "assistant", "x"), (3, 0, "assistant", "x")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, m int")
    got = {r.record_id: r for r in C.format_records(C.conversation_records(df)).collect()}
    assert C.read_turns(got[1].formatted) == [("user", "a"), ("assistant", "b")]
    assert C.read_turns(got[2].formatted) == [("", "")] and C.read_turns(got[None].formatted) == [("assistant", "</s>")]
    assert C.read_turns(got[3].formatted) == [("assistant", "x"), ("assistant", "x"), ("assistant", "y")]
    back = {r.record_id: r for r in C.read_back(C.format_records(C.conversation_records(df))).collect()}
    assert (back[1].n_turns, back[1].loss_chars, back[None].loss_chars, back[3].loss_chars) == (2, 1, 4, 3)
    assert C.read_back(C.format_records(C.conversation_records(df.limit(0)))).count() == 0


def test_roles_of_the_table_stay_as_they_are(spark):
    rows = [(1, 0, "human", "a"), (1, 1, "gpt", "b"), (1, 2, "model", "c"), (1, 3, "assistant", "d")]
    got = C.format_records(C.conversation_records(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert C.read_turns(got.first().formatted) == [(r, t) for _, _, r, t in rows]
    back = C.read_back(got).first()
    assert (back.loss_chars, back.n_turns) == (1, 4)
