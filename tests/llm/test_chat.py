"""Chat formatting: escapes, segments, digests and turn order against plain Python."""
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from veriledge.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows, moves=chat.CHAT.moves):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows
                        if r[0] == conv), key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))
        state, bad = "start", None
        for place, (_, _, role, _) in enumerate(turns):
            if (state, role) not in moves:
                bad = place
                break
            state = moves[state, role]
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        out[conv] = (len(turns), sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns)), len(loss),
                     sha(loss), bad is None, bad, state)
    return out


def found(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = chat.format_and_read(spark, df).collect()
    assert len({r["conv_id"] for r in got}) == len(got)
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"],
                           r["legal"], r["first_illegal"], r["last_state"]) for r in got}


TEXTS = ["", "hi", "<|im_end|>", "<\\|im_start|>", "<\\\\|x|>", "<", "|im_end|>", "a<|im_start|>user\n",
         "\\", "<|nl|>", "é\n\n<|", "😀", "$1 \\1 {text} {role}", "<|<|<\\|"]


def test_escapes_are_reversible_and_hide_control_strings(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for t, e, u in df.select("t", chat.escape(F.col("t")),
                             chat.unescape(chat.escape(F.col("t")))).collect():
        assert u == t and "<|" not in e


def test_random_conversations_equal_plain_python(spark):
    rng = random.Random(1)
    roles = ["system", "user", "assistant", "tool", None, "", "odd\nrole<|", "assistant", "user"]
    rows = [(conv, rng.choice([None, *range(-70, 200)]), rng.choice(roles), rng.choice([None, *TEXTS]))
            for conv in [None, *range(40)] for _ in range(rng.randint(1, 30))]
    rows += rows[:10]
    assert found(spark, rows) == expected(rows)


def test_legal_order_over_many_parts(spark):
    order = ["system"] + ["user", "assistant", "tool", "assistant"] * 100
    rows = [(1, i, r, f"t{i}") for i, r in enumerate(order)]
    rows += [(2, i, "user" if i == 300 else r, "x") for i, r in enumerate(order)]
    got = found(spark, rows)
    assert got == expected(rows)
    assert got[1][4] and got[2][5] == 300


def test_loss_flags_follow_the_template(spark):
    template = chat.Template(turns={"user": ((chat.BEGIN + "{role}\n", False), ("{text}", True),
                                             (chat.END, False))})
    df = spark.createDataFrame([(1, 0, "user", "a<|b"), (1, 1, "assistant", "c")], SCHEMA)
    row = chat.formatted(df, template).first()
    assert [tuple(s) for s in row["segments"]] == [
        ("<|im_start|>user\n", False), ("a<\\|b", True), ("<|im_end|>", False),
        ("<|im_start|>assistant\n", False), ("c", False), ("<|im_end|>\n", False)]
    assert chat.format_and_read(spark, df, template).first()["loss_sha256"] == sha("a<|b")


def test_long_texts_extra_columns_and_empty_tables(spark):
    long = "x<|" * 300_000
    rows = [(7, 0, "user", long), (7, 1, "assistant", long)]
    assert found(spark, rows) == expected(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    wide = df.withColumn("part", F.lit(1)).withColumn("segments", F.lit("s"))
    assert chat.format_and_read(spark, wide).count() == 1
    with_extra = chat.with_control_texts(spark, wide)
    assert {r["conv_id"]: r["legal"] for r in chat.format_and_read(spark, with_extra).collect()} \
        == {7: True, -1: True}
    assert chat.format_and_read(spark, df.limit(0)).collect() == []


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, 0, "user", "a")], SCHEMA).limit(1)
    plan = chat.formatted(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
