"""The stages against brute force, one after another on a small table."""

import math
import re
from collections import Counter

import corpus_pipeline
from strandline.llm.quality import CURRENT, RULES
from tests.llm.test_minhash import brute as brute_near
from tests.llm.test_quality import measure
from tests.llm.test_sharding import brute as brute_shards
from tests.oracle import SMALL


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, rows = docs.columns, sorted((tuple(r) for r in docs.collect()), key=lambda r: r[0])
    at = {c: i for i, c in enumerate(columns)}
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    text = lambda r: r[at["text"]]
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SMALL)
        assert out.columns == columns, name
        got = sorted((tuple(r) for r in out.collect()), key=lambda r: r[0])
        if name == "quality rules":
            fails = lambda t: any(eval(x.fails, {}, measure(t)) for x in RULES if x.name in CURRENT.rules)
            rows = [r for r in rows if not fails(text(r))]
            assert got == rows
        elif name == "near duplicates":
            kept = {i for i, _, _, k in brute_near([(r[0], text(r)) for r in rows], 80) if k}
            rows = [r for r in rows if r[0] in kept]
            assert got == rows
        elif name == "decontamination":
            rows = [r for r in rows if not any(x in text(r) for x in items)]
            assert got == rows
        else:
            n = Counter(r[0] for r in got)
            assert set(got) == set(rows)
            tokens, share = {}, Counter()
            for r in rows:
                tokens[r[0]] = len(re.findall(r"[^\x20\x09-\x0d]+", text(r)))
                share[r[at["source"]]] += tokens[r[0]]
            # exponent: the least one whose most repeated source stays within 1.5
            a = max(0.0, 1 - math.log(1.5) / math.log(max(share.values()) / min(share.values())))
            scale = 1 / min(t**a / t for t in share.values())
            for s, t in share.items():
                quota = t**a * scale
                drawn = sum(tokens[r[0]] * n[r[0]] for r in rows if r[at["source"]] == s)
                longest = max(tokens[r[0]] for r in rows if r[at["source"]] == s)
                assert quota - longest - 1 <= drawn <= quota + 1
            rows = got
        docs = out
    out = corpus_pipeline.STAGES[4][1](spark, docs, SMALL).collect()
    assert sorted((str(r[0]), *tuple(r)[1:]) for r in out) == brute_shards([(r[0], text(r)) for r in rows], 8)
    again = corpus_pipeline.run(spark, SMALL)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out))
