"""Mixing: the exponent by plain bisection, every draw by a plain walk."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from strandline.llm import mixing
from strandline.llm.mixing import Mix, mix_sources

SCHEMA = "doc_id long, text string, source string, epoch string, row string"


def corpus():
    r = random.Random(1)
    sizes = {"big": 300, "mid": 90, "small": 40, None: 25, "empty": 5}
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((i, None if s == "empty" else " ".join(["w"] * r.randint(0, 30)), s, "clash", "clash"))
            i += 1
    return rows


def exponent(t, good, largest):
    lo, hi = 0.0, 1.0
    if good(hi) and largest or good(lo) and not largest:
        return hi if largest else lo
    for _ in range(80):
        m = (lo + hi) / 2
        if good(m) == largest:
            lo = m
        else:
            hi = m
    return lo if largest else hi


@pytest.mark.parametrize("mix", [Mix(max_repeats=2.5), Mix(max_repeats=None, entropy=0.9), Mix(max_repeats=1.2, budget=3000), Mix(max_repeats=None, entropy=0.5, budget=20000)])
def test_draws(spark, mix, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = mix_sources(df, mix)
    got = {}
    for x in out.select("row.doc_id", "epoch", "n_tokens", "block", "place").collect():
        got.setdefault(x.doc_id, []).append((x.epoch, x.block, x.place))
    tokens = {d: len(re.findall(r"\S+", t or "")) for d, t, *_ in rows}
    t = {}
    for d, _, s, *_ in rows:
        t[s] = t.get(s, 0) + tokens[d]
    shared = {s: n for s, n in t.items() if n}

    def entropy(a):
        z = sum(n**a for n in shared.values())
        return -sum(n**a / z * math.log(n**a / z) for n in shared.values())

    def repeats(a):
        pace = [n**a / n for n in shared.values()]
        z = sum(n**a for n in shared.values())
        return max(pace) / min(pace) if mix.budget is None else mix.budget * max(pace) / z

    if mix.entropy is not None:
        a = exponent(shared, lambda a: entropy(a) >= mix.entropy * math.log(len(shared)), True)
    else:
        a = exponent(shared, lambda a: repeats(a) <= mix.max_repeats, False)
    scale = 1 / min(n**a / n for n in shared.values()) if mix.budget is None else mix.budget / sum(n**a for n in shared.values())
    places = {(x.rid, x.e): x.h for x in spark.createDataFrame([(d, e) for d in tokens for e in range(60)], "rid long, e long").select("rid", "e", F.xxhash64(F.lit(mix.seed).cast("long"), "e", "rid").alias("h")).collect()}
    want = {}
    for s, n in t.items():
        own = [d for d, _, x, *_ in rows if x == s]
        quota = int(shared.get(s, 0) ** a * scale + 1e-6) if n else 0
        full, rest = divmod(quota, n) if n else (1, 0)
        for d in own:
            want[d] = full
        for d in sorted(own, key=lambda d: (places[d, full] % (1 << 64), d)) if rest else ():
            rest -= tokens[d]
            if rest < 0:
                break
            want[d] += 1
    assert {d: len(x) for d, x in got.items()} == {d: k for d, k in want.items() if k}
    for x in got.values():
        assert sorted(e for e, *_ in x) == list(range(len(x)))
    if mix.budget is None:
        assert set(got) == set(tokens)
    assert out.schema["row"].dataType.names == df.columns


def test_large_sources_give_all_their_tokens(spark):
    """Where rounding errors exceed a token's millionth, none gives less than it has."""
    r = random.Random(2)
    for alpha in (0.37, 0.71, 1.0):
        shared = spark.createDataFrame([(str(i), 10**15 + r.randrange(10**14)) for i in range(50)], "source string, tokens long")
        assert not mixing._quotas(shared, alpha, Mix()).where("quota < all").collect()


def test_same_ids_and_empty(spark):
    rows = [(1, "a b c", "x", "", ""), (1, "a b c", "x", "", ""), (None, "d e", "y", "", ""), (None, None, None, "", "")]
    out = mix_sources(spark.createDataFrame(rows, SCHEMA), Mix(max_repeats=3.0)).select("row.*").collect()
    assert {tuple(r) for r in out} == {tuple(r) for r in rows}
    assert sum(r.doc_id == 1 for r in out) >= 2
    assert mix_sources(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(ValueError):
        Mix(entropy=0.5) and mix_sources(spark.createDataFrame(rows, SCHEMA), Mix(entropy=0.5))
