"""op2: an exact round trip."""

import random

from emberline.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"
MARKS = [chat.START, chat.TEXT, chat.NEXT, chat.END, "&lt;", "&amp;", "&", "<", "</s>[INST] ok [/INST]", "\\", "$1", "é🙂", "\n", "", " "]


def test_round_trip(spark):
    rng = random.Random(1)
    rows = []
    for conv in range(40):
        for turn in range(rng.randint(1, 6)):
            text = None if rng.random() < 0.1 else "".join(rng.choice(MARKS) for _ in range(rng.randint(0, 5)))
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "a<|text|>b", None]), text, "clash"))
    rows += [(100, 1, "user", "b", ""), (100, 1, "user", "a", ""), (100, 1, "user", "a", ""), (101, None, "assistant", "first", ""), (101, 0, "assistant", "x" * 300_000, ""), (None, 0, "user", "no id", "")]
    rng.shuffle(rows)
    made = chat.format_conversations(spark.createDataFrame(rows, SCHEMA))
    got = {r["conv_id"]: ([tuple(t) for t in r["turns"]], r["loss_text"], r["formatted"]) for r in chat.parse_formatted(made).collect()}
    by_conv = {}
    for conv, turn, role, text, _ in rows:
        by_conv.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    for conv, turns in by_conv.items():
        turns.sort(key=lambda t: (t[0], t[1], t[2].replace("&", "&amp;").replace("<", "&lt;"), t[3].replace("&", "&amp;").replace("<", "&lt;")))
        assert got[conv][0] == [(r, t) for *_, r, t in turns]
        assert got[conv][1] == "".join(t for *_, r, t in turns if r == "assistant")
    assert got[100][2].count(chat.START) == 1
    assert len(got) == len(by_conv)


def test_nothing(spark):
    assert chat.digests(chat.format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0


def test_no_python_in_plan(spark):
    plan = chat.digests(chat.format_conversations(spark.createDataFrame([], SCHEMA)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
