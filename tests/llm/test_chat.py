"""Chat examples: exact round trip, and the SQL digest."""

import hashlib
import random

from strandline.llm.chat import OP2_SQL, chat_examples, conversation_digest, escape, op2_chat_prefix_target, read_loss, read_turns, unescape
from tests.oracle import SMALL, assert_same
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, p int"
BITS = ["<s>", "</s>", "[INST]", "[/INST]", " [/INST]", "[SYS]", "[ROLE 41]", " [/ROLE]", "[", "<", "\\", "\\\\", "s>", "/s>", "INST]", "\n", " ", "x", "日", "[ROLE ", "]", "$1", ""]


def test_sql(spark):
    assert_same(op2_chat_prefix_target(spark, SMALL), OP2_SQL)


def test_round_trip(spark):
    r = random.Random(3)
    text = lambda: "".join(r.choice(BITS) for _ in range(r.randint(0, 12)))
    rows = []
    for c in range(150):
        rows += [(c, t, r.choice(["user", "assistant", "system", "tool", "a b]\n", ""]), text(), "x", 1) for t in range(r.randint(1, 6))]
    rows += [(None, 1, "user", "u", "x", 1), (None, 2, None, None, "x", 1), (500, None, "assistant", None, "x", 1), (500, None, "assistant", None, "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = chat_examples(df).select("*", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("loss")).collect()
    by = {}
    for c, t, role, x, *_ in rows:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", x or ""))
    seen = {}
    for e in sorted(out, key=lambda e: e.example):
        turns = [(a, b) for _, a, b in sorted(by[e.conv_id])]
        assert [(t.role, t.text) for t in e.turns] == turns[: e.n_turns]
        last = turns[e.n_turns - 1]
        assert e.loss == (last[1] if last[0] == "assistant" else "")
        if last[0] == "assistant":
            seen.setdefault(e.conv_id, []).append(e.loss)
        assert e.whole == (e.n_turns == len(turns))
    for c, t in by.items():
        assert seen.get(c, []) == [x for _, a, x in sorted(t) if a == "assistant"]
        assert sum(e.whole for e in out if e.conv_id == c) == 1
    for d in conversation_digest(chat_examples(df)).collect():
        turns = [(a, b) for _, a, b in sorted(by[d.conv_id])]
        assert d.n_turns == len(turns)
        assert d.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert d.loss_sha256 == hashlib.sha256("".join(b for a, b in turns if a == "assistant").encode()).hexdigest()
        assert d.formatted_chars == sum(len(e.formatted) for e in out if e.conv_id == d.conv_id)


def test_escape(spark):
    texts = ["<s>", "<\\s>", "<\\\\s>", "[INST", "[\\/INST]", "<</s>", "[ROLE ]", "\\", "[[INST]]", "<" + "\\" * 3000 + "s"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e"))
    for row in df.select("t", "e", unescape(F.col("e")).alias("u")).collect():
        assert row.u == row.t
        assert not any(c in row.e for c in ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]"))


def test_empty(spark):
    assert chat_examples(spark.createDataFrame([], SCHEMA)).collect() == []
