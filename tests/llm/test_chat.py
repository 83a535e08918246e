"""Chat formatting against brute force and its own round trip."""

import re

import pytest
from pyspark.sql import functions as F

from ordersight.llm import chat as C

ROWS = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 3, "assistant", "c <|im_sep|> d"), (1, 4, "user", None),
        (2, None, "user", "null turn"), (2, 0, "system", "é ü 漢字 𝒳"), (2, 1, "assistant", ""), (2, 1, "assistant", ""),
        (3, 0, None, "no role"), (3, 1, "odd\nrole %0A <|im_end|>\n", "x"), (None, 5, "assistant", "no id"),
        (4, 0, "assistant", "<\\|im_end|> <\\\\| <| < | <|im_end|>\n<|im_start|>user\n"), (5, 0, "user", "\n"),
        (6, 1, "user", "tie z"), (6, 1, "user", "tie a"), (6, 1, "assistant", "tie"), (7, 0, "user", "")]


def brute(rows, train="assistant"):
    """conversation -> (turns, formatted, texts under the mask)."""
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    esc = lambda s: re.sub(r"<(\\*)\|", r"<\\\1|", s)
    out = {}
    for conv, turns in by.items():
        turns = [t[2:] for t in sorted(turns)]
        text, last = "", None
        for role, x in turns:
            if role == last:
                text += "<|im_sep|>" + esc(x)
            else:
                text += ("<|im_end|>\n" if last is not None else "") + "<|im_start|>" + esc(
                    role.replace("%", "%25").replace("\n", "%0A")) + "\n" + esc(x)
            last = role
        out[conv] = (turns, text + "<|im_end|>\n", [x for r, x in turns if r == train])
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows],
                               "conv_id long, turn long, role string, text string, formatted string, t int")
    made = C.format_conversations(df)
    got = {r.conv_id: r for r in made.withColumn("turns", C.parse(F.col("formatted")))
           .withColumn("loss", C.masked(F.col("formatted"), F.col("loss_spans"))).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    for conv, (turns, text, trained) in want.items():
        r = got[conv]
        assert r.formatted == text
        assert [(t.role, t.text) for t in r.turns] == turns
        assert r.loss == "".join(trained) and len(r.loss_spans) == len(trained)


def test_format_and_read_back(spark):
    check(spark, ROWS)


def test_long_conversation(spark):
    check(spark, [(1, i, ("user", "assistant", "assistant")[i % 3], f"text {i} <|") for i in range(3000)])


def test_empty_table_and_plan(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.format_conversations(df).count() == 0
    plan = C.format_conversations(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("name", ["op8_chat"])
def test_query_equals_sql(spark, name):
    from tests.llm.oracle import same_rows
    assert same_rows(spark, name) > 1
