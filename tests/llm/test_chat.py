"""Chat formatting: exact round trips, merged runs and the loss mask."""

import random
from collections import defaultdict

from conftest import SF
from oracle_check import compare, connect
from pyspark.sql import functions as F

from tidemark.llm import chat

PARTS = ["</s>", "<s>", "[INST]", "[/INST]", "[NEXT]", "␛", "␛x", "x", "b", "o", "[IN", "ST]", "<", "/s>", " ", "\n", "\\Q", "\\E", "$1", "é", "\U0001f600", ""]


def plain(rows):
    """conv_id -> turns in order, empty for null."""
    turns = defaultdict(list)
    key = lambda r: [(x is not None, x if x is not None else 0) for x in (r[1],)] + [(x is not None, x or "") for x in r[2:]]
    for r in sorted(rows, key=key):
        turns[r[0]].append((r[2] or "", r[3] or ""))
    return dict(turns)


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    want = plain(rows)
    read = chat.format_chats(df).select("*", chat.read_back(F.col("formatted")).alias("turns"), chat.under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in read} == want and len(read) == len(want)
    for r in read:
        turns = want[r.conv_id]
        assert r.loss == "".join(t for role, t in turns if role == "assistant")
        assert [role for role, _ in r.runs] == [role for i, (role, _) in enumerate(turns) if i == 0 or turns[i - 1][0] != role]
        assert [t for _, texts in r.runs for t in texts] == [t for _, t in turns]
        assert r.formatted.count("</s>") == len(r.runs)
        assert [r.formatted[s.start : s.stop] for s in r.loss_spans] == [r.formatted[s.start : s.stop] for s in sorted(r.loss_spans)]


def test_random_control_strings_round_trip(spark):
    rng = random.Random(6)
    text = lambda: "".join(rng.choice(PARTS) for _ in range(rng.randrange(8)))
    check(spark, [(c, t, rng.choice(["user", "assistant", "assistant", "system", text()]), text()) for c in range(60) for t in range(rng.randrange(1, 7))])


def test_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, None, "assistant", "first"), (2, 0, "assistant", "same"), (2, 0, "assistant", "same"), (2, 0, "assistant", "tie"), (None, 0, "user", "no id"), (None, 1, "assistant", "")]
    rows += [(3, i, "assistant" if i % 3 else "user", "long " * 2000) for i in range(50)] + [(4, i, "user", str(i)) for i in range(3000)]
    check(spark, rows)
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(empty).count() == 0


def test_whole_table_against_sql(spark):
    from __spark_entry__ import oracle_sql, queries

    name = "op7_chat_formatting"
    assert compare(spark, connect(SF), queries()[name], oracle_sql()[name], SF).startswith("ok")


def test_long_conversation_over_block_borders(spark):
    n = 2 * chat.BLOCK + 5
    rows = [(1, i, "assistant" if i % 3 else "user", f"{i} </s>␛ x") for i in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    plan = chat.format_chats(df)
    assert "Window" not in plan._jdf.queryExecution().executedPlan().toString()
    r = plan.select("*", chat.read_back(F.col("formatted")).alias("back"), chat.under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert [(t.role, t.text) for t in r.back] == [(role, text) for _, _, role, text in rows]
    assert r.loss == "".join(text for _, _, role, text in rows if role == "assistant")
    assert [(run.role, list(run.texts)) for run in r.runs][:3] == [("user", [rows[0][3]]), ("assistant", [rows[1][3], rows[2][3]]), ("user", [rows[3][3]])]
