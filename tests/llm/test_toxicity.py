"""The network: gradients by differences, windows, held-out accuracy."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from strandline.llm.toxicity import Network, Training, _join, fit, op3_attention_toxicity, toxicity_scores, train
from tests.oracle import SMALL

SCHEMA = "doc_id long, text string, score string, zero int"


def test_gradients():
    net = Network.start(np.empty(0, np.uint64), Training())
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words, windows, text = net.encode(*_join(["one two bad three one", "a b c", "x " * 40]))
    y, w = np.array([1, 0, 1, 0], float)[: len(windows)], np.array([1, 2, 1, 3], float)[: len(windows)]

    def loss():
        l = net.forward(net.vectors(words).astype(np.float64), windows)
        return float((w * (np.logaddexp(0, l) - y * l)).sum() / w.sum())

    g, r = net.gradients(words, windows, y, w), np.random.default_rng(1)
    for k, v in net.p.items():
        for _ in range(4):
            i = tuple(int(r.integers(0, n)) for n in v.shape)
            if k == "char":
                i = (int(r.choice(words[1])), i[1])
            old = v[i]
            v[i] = old + 1e-2
            up = loss()
            v[i] = old - 1e-2
            down = loss()
            v[i] = old
            assert abs((up - down) / 2e-2 - g[k][i]) < 2e-3 * (abs(g[k][i]) + 1)


def test_windows_cover_texts():
    r, net = random.Random(2), Network.start(np.empty(0, np.uint64), Training())
    texts = [" ".join("w%d" % r.randint(0, 50) for _ in range(n)) for n in (0, 1, 31, 32, 33, 48, 49, 300)] + ["", "?!"]
    _, windows, text = net.encode(*_join(texts))
    for i, t in enumerate(texts):
        own = windows[text == i]
        n = len([w for w in t.split() if w.isalnum()])
        assert len(own) == max(1, -(-(n - 32) // 16) + 1)
        assert (own >= 0).sum(axis=1).min() >= min(n, 17) and (own >= 0).any(axis=0).sum() == min(n, 32)
        step = [list(x[x >= 0]) for x in own]
        whole = step[0] + [y for a, b in zip(step, step[1:]) for y in b[16:]]
        assert len(whole) == n
    # a batch of texts scores as each text does alone
    alone = [float(net.scores(*_join([t]))[0]) for t in texts]
    assert np.allclose(alone, net.scores(*_join(texts)), atol=1e-5)


def corpus(n, seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeést") for _ in range(r.randint(2, 7))) for _ in range(500)]
    out = []
    for i in range(n):
        t = [r.choice(words) for _ in range(r.randint(3, 200))]
        toxic = int(r.random() < 0.3)
        for _ in range(r.randint(1, 3) if toxic else 0):
            t.insert(r.randint(0, len(t)), r.choice(["zonk", "Zonker!", "vlurp", "VLURPS,"]))
        out.append((i, " ".join(t), toxic))
    return out


def test_held_out(spark):
    rows = corpus(900, 3)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t, _ in rows], SCHEMA).repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5, None), (None, 1), (100000, 1)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity_scores(docs, fit(docs, labels, Training(epochs=8))).collect()}
    assert len(out) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for i, r in out.items())
    held = [(out[i].predicted, y) for i, _, y in rows if out[i].held_out]
    assert np.mean([p == y for p, y in held]) > 0.93


def test_edges(spark):
    net = train(["good words stand here", "bad zonk", "", "zonk"] * 10, np.array([0, 1, 0, 1] * 10, np.float32))
    rows = [(None, None, "", 1), (1, "", "", 1), (1, "", "", 1), (2, "zonk " * 30000, "", 1), (3, "good", "", 1)]
    out = toxicity_scores(spark.createDataFrame(rows, SCHEMA), net).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in out if r.doc_id in (None, 1)} == {next(r.score for r in out if r.doc_id is None)}
    assert next(r.score for r in out if r.doc_id == 2) > 0.5 > next(r.score for r in out if r.doc_id == 1)
    empty = spark.createDataFrame([], SCHEMA)
    assert toxicity_scores(empty, fit(empty, spark.createDataFrame([], "doc_id long, toxic int"))).collect() == []


def test_query(spark):
    df = op3_attention_toxicity(spark, SMALL)
    assert [c for c, _ in df.dtypes] == ["doc_id", "held_out", "score", "predicted"]
    assert df.where(F.col("score").isNull()).count() == 0 and df.count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()
