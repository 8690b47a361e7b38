"""Quality rules against the SQL and a plain count."""

import random
import re


from strandline.llm.quality import CURRENT, OP10_SQL, POLICIES, RULES, ablations, keep_passing, op10_quality_ledger, rule_ledger
from tests.oracle import SMALL, assert_same

SCHEMA = "doc_id long, text string, n_words string, failed string, row string"


def test_sql(spark):
    assert_same(op10_quality_ledger(spark, SMALL), OP10_SQL)


def measure(t):
    t = t or ""
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", t) if x]
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    cover = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(cover)}


def corpus():
    r = random.Random(2)
    words = ["a", "bé", "日本", "#x", "w1", "w2", "w3"]
    texts = ["".join(r.choice(words) + r.choice([" ", "  ", "\n", "\t", "\n\n"]) for _ in range(r.choice([0, 3, 8, 9, 25, 120]))) for _ in range(60)]
    line = " ".join("w%d" % i for i in range(30))
    return [*texts, None, "", " \n\t", "x " * 5000, "\n".join([line] * 4), line, line, "\x1c \xa0   x"]


def test_counts(spark):
    rows = [(None if i == 3 else i, t, "clash", "clash", "clash") for i, t in enumerate(corpus())]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = rule_ledger(df).collect()
    assert len(out) == len(rows)
    for r in out:
        m = measure(r.row.text)
        assert {k: r[k] for k in m} == m, r.row.text
        assert r.failed == sum(1 << x.bit for x in RULES if eval(x.fails.replace("=", "==") if "==" in x.fails else x.fails, {}, m))
        assert r.row.n_words == "clash"
    kept = keep_passing(df)
    assert kept.columns == df.columns
    assert sorted(r.text for r in kept.collect()) == sorted(r.row.text for r in out if not r.failed & CURRENT.mask())
    got = {(r.policy, r.rule): tuple(r)[2:] for r in ablations(rule_ledger(df)).collect()}
    bits = [r.failed for r in out]
    for p in POLICIES:
        for x in RULES:
            if x.name in p.rules:
                own = [b & p.mask() for b in bits]
                assert got[p.version, x.name] == (sum(o != 0 for o in own), sum(bool(o >> x.bit & 1) for o in own), sum(o == 1 << x.bit for o in own))


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert rule_ledger(empty).collect() == []
    assert ablations(rule_ledger(empty)).collect() == []
    assert keep_passing(empty).collect() == []
