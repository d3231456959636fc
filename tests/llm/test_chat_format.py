"""Formatted conversations against a plain reading of the template."""

import hashlib
import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from orderlens.llm import chat_format

SCHEMA = "conv_id long, turn long, role string, text string"
MARKS = ["<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[TEXT]", "[/TEXT]", "[TURN]"]


def rows_of():
    rng = random.Random(3)
    pieces = [*MARKS, *[m[0] + "\\" * k + m[1:] for m in MARKS for k in (1, 2)], "\\", "<", "[", "s>",
              "INST]", "é😀", "\n", " ", "plain", "$1", ""]
    roles = ["user", "assistant", "system", "tool", "[TEXT]", "User", "</s>", ""]
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 12)):
            text = "".join(rng.choices(pieces, k=rng.randint(0, 8)))
            rows.append((conv, turn, rng.choice(roles[: 2 if conv % 2 else 8]), text))
    rows += [
        (100, None, None, None), (100, 1, "assistant", None), (101, 2, None, "x"), (101, 2, "", "x"),
        (102, 5, "user", "b"), (102, 5, "user", "a"), (102, 5, "assistant", "a"), (102, 5, "user", "a"),
        (None, 1, "assistant", "of no id"), (None, 0, "user", "<s>"),
        (103, 0, "assistant", "ab[TURN] " * 50_000), (103, 1, "assistant", "\\</s>"),
    ]
    rows += [(104, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(3_000)]
    return rows


def expected(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0], t[1].encode(), t[2].encode()))
        told = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        out[conv] = (
            len(turns),
            hashlib.sha256(told.encode()).hexdigest(),
            len(loss),
            hashlib.sha256(loss.encode()).hexdigest(),
            len(list(groupby(turns, key=lambda t: t[1]))),
        )
    return out


@pytest.fixture(scope="module")
def formatted(spark):
    df = spark.createDataFrame(rows_of(), SCHEMA).repartition(4)
    # names that the operator uses inside must not clash with extra columns
    names = ("turns", "_turns", "_starts", "blocks", "segments", "formatted", "n_turns", "_loss")
    return chat_format.format_chats(df.withColumns({c: F.lit(1) for c in names}))


def test_reads_back_what_was_formatted(formatted):
    got = {
        r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.n_blocks)
        for r in chat_format.digest(formatted).collect()
    }
    assert got == expected(rows_of())


def test_texts_hold_no_bare_mark(formatted):
    for r in formatted.collect():
        assert "".join(s.text for s in r.segments) == r.formatted
        marks = [s.text for s in r.segments[::1] if s.text in MARKS and not s.loss]
        # every mark that stands in the text as it is was set by the template
        if r.conv_id is not None and r.conv_id % 2 and r.conv_id < 60:  # users and assistants only
            assert sum(r.formatted.count(m) for m in MARKS) == len(marks)
        for s in r.segments:
            if s.loss:
                assert not any(m in s.text for m in MARKS)


def test_layout(spark):
    rows = [(1, 0, "system", "be\\ kind"), (1, 1, "user", "hi"), (1, 2, "user", "<s>[TURN]"), (1, 3, "assistant", "ok")]
    one = chat_format.format_chats(spark.createDataFrame(rows, SCHEMA)).first()
    assert one.formatted == (
        "[ROLE]system[TEXT]be\\ kind[/TEXT][INST]hi[TURN]<\\s>[\\TURN][/INST]<s>ok</s>"
    )
    assert (one.n_turns, one.n_blocks) == (4, 3)
    assert [s.text for s in one.segments if s.loss] == ["ok"]


def test_other_templates(spark):
    chatml = chat_format.Template(
        user=("<|user|>", "<|end_user|>"), assistant=("<|bot|>", "<|end_bot|>"),
        named="<|role|>", other=("<|text|>", "<|end|>"), next_turn="<|next|>",
    )
    rows = [(1, 0, "user", "<|bot|><\\|bot|>"), (1, 1, "assistant", "<|next|>"), (1, 2, "x", "")]
    made = chat_format.format_chats(spark.createDataFrame(rows, SCHEMA), chatml)
    turns = made.select(chat_format.read_turns(F.col("formatted"), chatml).alias("t")).first().t
    assert [(t.role, t.text) for t in turns] == [r[2:] for r in rows]
    for bad in ({"next_turn": "<s>"}, {"next_turn": "<a<b>"}, {"next_turn": "x\\y"}, {"named": "["}):
        with pytest.raises(ValueError):
            chat_format.Template(**bad)


def test_nothing_and_no_python(spark, formatted):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat_format.digest(chat_format.format_chats(empty)).count() == 0
    plan = chat_format.digest(formatted)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
