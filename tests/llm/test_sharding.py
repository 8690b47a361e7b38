"""Shards against plain bisection over the groups."""

import random
import zlib

import numpy as np
import pytest

from strandline.llm import sharding
from strandline.llm.sharding import minimax_shards

SCHEMA = "doc_id long, text string, shard string, size string, part string"


def brute(rows, k):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    groups = {}
    for r in order:
        groups.setdefault(r[1] or "", []).append(r)
    size = lambda t: len((t or "").encode()) + 1
    sizes = [sum(size(r[1]) for r in g) for g in groups.values()]

    def fill(c):
        out, used = [0], 0
        for s in sizes:
            if used + s > c:
                out.append(0)
                used = 0
            used += s
            out[-1] += 1
        return out

    c = max(sizes)
    while len(fill(c)) > k:
        c += 1
    out, g = [], iter(groups.values())
    for shard, n in enumerate(fill(c)):
        own = [r for _ in range(n) for r in next(g)]
        out += [(str(r[0]), size(r[1]), zlib.crc32((r[1] or "").encode()), "bytes", shard, slot, None) for slot, r in enumerate(own)]
    return sorted(out)


def corpus(seed, n):
    r = random.Random(seed)
    texts = ["é" * r.randint(0, 80) + str(r.randint(0, 40)) for _ in range(n)]
    rows = [(i * 3, t if r.random() > 0.3 else texts[0], "c", "c", "c") for i, t in enumerate(texts)]
    return rows + [(-5, None, "", "", ""), (9999, "", "", "", "")]


@pytest.mark.parametrize("seed,n,k,probes", [(1, 300, 8, 1024), (2, 120, 5, 3), (3, 4, 8, 4)])
def test_brute(spark, seed, n, k, probes, monkeypatch):
    monkeypatch.setattr(sharding, "PROBES", probes)
    rows = corpus(seed, n)
    out = minimax_shards(spark.createDataFrame(rows, SCHEMA).repartition(3), k).collect()
    assert sorted((str(r[0]), *tuple(r)[1:]) for r in out) == brute(rows, k)


def test_same_ids_and_empty(spark):
    rows = [(None, "a", "", "", ""), (2, "a", "", "", ""), (2, "a", "", "", ""), (2, "bbb", "", "", ""), (None, None, "", "", "")]
    out = minimax_shards(spark.createDataFrame(rows, SCHEMA), 2).collect()
    assert sorted((str(r[0]), *tuple(r)[1:]) for r in out) == brute(rows, 2)
    assert minimax_shards(spark.createDataFrame([], SCHEMA)).collect() == []


def test_lookup(spark):
    df = spark.createDataFrame([(0, 5, 5), (0, 2, 7), (3, 4, 4), (3, 9, 13)], "part int, size long, upto long")
    sums = sharding.PrefixSums(df)
    assert sums.largest(np.array([0, 4, 5, 6, 7, 10, 11, 19, 20, 99])).tolist() == [0, 0, 5, 5, 7, 7, 11, 11, 20, 20]
