"""Near duplicates against all pairs, by exact shingle sets."""

import random

import numpy as np
import pytest

from strandline.llm.graph import components
from strandline.llm.minhash import Forest, near_duplicates, shingle_sets, signatures

SCHEMA = "doc_id long, text string, n int, root string"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def words(t):
    return lower(t or "").encode().split()


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, percent):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                p, q = sorted((root(i), root(j)))
                up[q] = p
    return [(rows[i][0], len(sets[i]), rows[root(i)][0], root(i) == i) for i in range(len(rows))]


def corpus(seed, n=120):
    r = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)] + ["É", "ß", "日本", "A", "The"]
    rows = []
    for i in range(n):
        k = r.random()
        if rows and k < 0.55:
            w = (r.choice(rows)[1] or "").split()
            for _ in range(r.randint(0, 3)):
                if w:
                    w[r.randrange(len(w))] = r.choice(vocabulary)
            t = " ".join(w) if k > 0.2 else "\n ".join(x.upper() if x.isascii() else x for x in w)
        else:
            t = " ".join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 3, 4, 5, 9, 40, 120, 300])))
        rows.append((i * 7 + 3, t))
    return rows + [(5000, None), (5001, ""), (5002, "  \t"), (5003, "one two"), (5004, "ONE two"), (5005, "x " * 3000)]


def frame(spark, rows):
    r = list(rows)
    random.Random(5).shuffle(r)
    return spark.createDataFrame([(d, t, 1, "x") for d, t in r], SCHEMA).repartition(3)


@pytest.mark.parametrize("seed,forest", [(1, Forest()), (2, Forest(percent=80, depth=3)), (3, Forest(room=600, region=4))])
def test_all_pairs(spark, seed, forest):
    rows = corpus(seed)
    out = near_duplicates(frame(spark, rows), forest).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out) == sorted(brute(rows, forest.percent))


@pytest.mark.parametrize("edits,forest", [(3, Forest()), (3, Forest(room=1 << 22)), (6, Forest(room=2800)), (4, Forest(room=2800, most=5000))])
def test_dense_group(spark, edits, forest):
    """Very many copies of one text, each with edits of its own: links near the
    threshold, of which neighbours alone miss some. In one chunk and in some 17."""
    r = random.Random(8)
    base = ["b%d" % i for i in range(120)]
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = "e%d" % r.randint(0, 10**6)
        rows.append((i, " ".join(w)))
    out = near_duplicates(frame(spark, rows), forest).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in out) == sorted(brute(rows, 85))


def test_group_beyond_room(spark):
    """A group of some 50 chunks in which each document is similar to the one
    it was made from and to those made from it, wherever they were dealt."""
    r = random.Random(4)
    rows = [(0, " ".join("b%d" % i for i in range(120)))]
    for i in range(1, 400):
        w = r.choice(rows[-60:])[1].split()
        w[r.randrange(len(w))] = "e%d" % i
        rows.append((i, " ".join(w)))
    out = near_duplicates(frame(spark, rows), Forest(room=1000)).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in out) == sorted(brute(rows, 85))


def test_crowded_prefix_over_many_tasks(spark):
    """One tree, one prefix of four values that most documents share, 64 tasks:
    whoever shares it is a candidate, also where longer prefixes differ."""
    f, r = Forest(trees=1), random.Random(6)
    base = ["b%d" % i for i in range(300)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(r.randint(2, 4)):
            w[r.randrange(len(w))] = "e%d" % r.randint(0, 10**6)
        rows.append((i, " ".join(w)))
    raw = [t.encode() for _, t in rows]
    sets, at = shingle_sets(f.words, np.cumsum([0] + [len(x) for x in raw]).astype(np.int64), np.frombuffer(b"".join(raw), np.uint8))
    sig = signatures(sets, at, 8)
    assert len(np.unique(sig, axis=0)) > 20
    largest = max((tuple(x) for x in sig[:, :4].tolist()), key=[tuple(x) for x in sig[:, :4].tolist()].count)
    crowd = [x for x, s in zip(rows, sig[:, :4].tolist(), strict=True) if tuple(s) == largest]
    assert len(crowd) >= 100
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        out = near_duplicates(frame(spark, crowd), f).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert sorted((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in out) == sorted(brute(crowd, 85))


def test_same_and_null_ids(spark):
    t = "one two three four five six seven"
    out = near_duplicates(frame(spark, [(None, t), (4, t), (4, t), (4, "other words stand here alone now")])).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in out) == [("4", "4", True), ("4", "None", False), ("4", "None", False), ("None", "None", True)]


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (200, 201)]
    out = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(41)}, 100: 90, 90: 90, 95: 90, 200: 200, 201: 200}
