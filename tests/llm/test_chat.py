import random

import pytest

from gridloom.llm import chat

BITS = ["\\", "#", "### ", "###", "</turn>", " </turn>\n", ": ", ":", "\n", "é", "🙂", "ok", "\\### Assistant: </turn> ok", "</", "turn>", ""]


@pytest.mark.parametrize("seed", [1, 2])
def test_round_trip(spark, monkeypatch, seed):
    r = random.Random(seed)
    text = lambda: "".join(r.choice(BITS) for _ in range(r.randint(0, 8)))
    turns = {c: [(t, r.choice(["user", "assistant", "a:b\\", "", None, "### x"]), r.choice([text(), text(), None, text() * 30])) for t in range(r.randint(1, 6))] for c in range(40)}
    turns[None] = [(0, "assistant", "x")]
    rows = [(c, t, role, x, "y") for c, own in turns.items() for t, role, x in own]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    monkeypatch.setattr(chat, "BUFFER_BYTES", 400)
    monkeypatch.setattr(chat, "SLICED_BYTES", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        made = chat.format_chat(df).collect()
        read = {x.conv_id: x for x in chat.read_chat(chat.format_chat(df)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(made) == len(turns) == len(read)
    for row in made:
        own = [(role or "", x or "") for _, role, x in sorted(turns[row.conv_id], key=lambda t: t[0])]
        assert row.n_turns == len(own)
        assert row.formatted.count("###") == row.formatted.count("</turn>") == len(own)
        got = read[row.conv_id]
        assert [(t.role, t.text) for t in got.turns] == own
        assert got.learnt == [x for role, x in own if role == "assistant"]
        data = row.formatted.encode()
        assert [chat.unescape(data[s.begin : s.end].decode()) for s in row.loss] == got.learnt


def test_empty_and_repeats(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert chat.read_chat(chat.format_chat(spark.createDataFrame([], schema))).count() == 0
    (one,) = chat.format_chat(spark.createDataFrame([(1, 0, "user", "a")] * 2 + [(1, None, "user", "b")], schema)).collect()
    assert chat.parse(one.formatted) == [("user", "b"), ("user", "a"), ("user", "a")]
