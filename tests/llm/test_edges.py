"""Very long texts, equal hashes, many null ids, a plain network, and the
pipeline over odd and empty tables."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import mixing
from strandline.llm._common import keyed_rows
from strandline.llm.bm25 import contaminated_pairs
from strandline.llm.chat import chat_examples, conversation_digest
from strandline.llm.mixing import Mix, mix_sources
from strandline.llm.sharding import minimax_shards
from strandline.llm.tokens import token_counts, encoding, Attribution
from strandline.llm.toxicity import Network, Training, _join
from tests.llm.test_sharding import brute as brute_shards
from tests.oracle import SMALL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_long_conversation(spark):
    """A conversation of 200 turns: each reply with all turns before it."""
    rows = [(7, t, "user" if t % 2 == 0 else "assistant", f"</s>[INST] turn {t} " + "x" * (t % 13)) for t in range(200)]
    out = chat_examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted(r.n_turns for r in out.select("n_turns").collect()) == list(range(2, 201, 2))
    one = conversation_digest(out).head()
    assert one.n_turns == 200 and one.loss_chars == sum(len(r[3]) for r in rows if r[2] == "assistant")


def test_long_run_without_spaces(spark):
    """One word of 200,000 characters, and one long line among short ones."""
    r = random.Random(1)
    word = "".join(r.choice("abcdefghijklmnop") for _ in range(200_000))
    texts = [word, "a b\n" + "word " * 60_000 + "\nend"]
    got = token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    enc = encoding(Attribution())[0]
    for i, t in enumerate(texts):
        own = sorted((x for x in got if x.doc_id == i), key=lambda x: x.section)
        assert sum(x.n_tokens for x in own) == len(enc.encode_ordinary(t))
        assert [x.char_start for x in own] + [len(t)] == [0] + [x.char_end for x in own]


def test_long_rows_in_shards(spark):
    """One row larger than all others together, and a text of two million bytes."""
    rows = [(i, "t%d" % (i % 9) * (1 + i % 5)) for i in range(200)] + [(500, "é" * 1_000_000), (501, "y" * 100_000)]
    out = minimax_shards(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    c = Counter()
    for r in out:
        c[r.shard] += r.size
    assert max(c.values()) == 2_000_001 and len(out) == len(rows)
    rows = rows[:200] + [(501, "y" * 1_500)]
    out = minimax_shards(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    assert sorted((str(r[0]), *tuple(r)[1:]) for r in out) == brute_shards(rows, 8)


def test_long_text_with_an_item_at_its_end(spark):
    item = "Which river flows through the old town of the northern province? Answer: the quiet green river of stones."
    text = "filler words without any meaning here " * 40_000 + item
    docs = spark.createDataFrame([(1, text), (2, text[:-60]), (3, None)], "doc_id long, text string")
    got = contaminated_pairs(docs, spark.createDataFrame([(9, item), (10, "other words of an item. Answer: nothing")], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 9)]


@pytest.mark.parametrize("hashes", ["equal", "two"])
def test_equal_hashes_in_a_mix(spark, monkeypatch, hashes):
    """Rows with one place in the permutation: each is still drawn, budgets hold."""
    monkeypatch.setattr(mixing, "_order", lambda seed, epoch, rid: F.lit(0).cast("long") if hashes == "equal" else F.when(rid % 2 == 0, F.lit(5 << 60)).otherwise(F.lit(-3)).cast("long"))
    rows = [(i, "w " * (1 + i % 4), "en", "big" if i % 10 else "small", 1) for i in range(300)] + [(900, "long " * 20_000, "en", "big", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    out = mix_sources(docs, Mix(max_repeats=1.5)).select("row.doc_id", "row.source", "epoch", "n_tokens").collect()
    assert {r.doc_id for r in out} == {r[0] for r in rows}
    assert max(Counter((r.doc_id, r.epoch) for r in out).values()) == 1
    total, drawn = Counter(), Counter()
    for r in rows:
        total[r[3]] += len(r[1].split())
    for r in out:
        drawn[r.source] += r.n_tokens
    assert all(total[s] <= drawn[s] <= 1.5 * total[s] + 1 for s in total)


def test_many_null_ids(spark):
    """Rows with no id and one beginning stay apart, in the order of their texts."""
    rows = [(None, "the same boilerplate head of every page, number %05d" % i) for i in range(400)] + [(None, "twice")] * 3 + [(4, "x"), (4, None)]
    keyed, _ = keyed_rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    got = sorted((r.rid, r.key, r.text) for r in keyed.select("rid", "key", "text").collect())
    assert len({g[0] for g in got}) == len(rows)
    assert [g[1:] for g in got] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))


def _plain_logits(net, words, windows):
    """The network place by place."""
    p, h = net.p, net.hidden
    ids, slot, which, n = words
    sig = lambda v: 1 / (1 + math.exp(-v))
    x = [np.concatenate([p["word"][ids[i]], np.mean([p["char"][s] for s, w in zip(slot, which) if w == i], axis=0)]) for i in range(n)]
    out = []
    for window in windows:
        own = [x[w] for w in window if w >= 0]
        states = {}
        for k, order in (("f", range(len(own))), ("b", range(len(own) - 1, -1, -1))):
            s = np.zeros(h)
            for t in order:
                gx, gh = own[t] @ p[f"w{k}"] + p[f"b{k}"], s @ p[f"u{k}"] + p[f"c{k}"]
                nxt = []
                for j in range(h):
                    r, z = sig(gx[j] + gh[j]), sig(gx[h + j] + gh[h + j])
                    nxt.append((1 - z) * math.tanh(gx[2 * h + j] + r * gh[2 * h + j]) + z * s[j])
                s = np.array(nxt)
                states[k, t] = s
        pairs = [np.concatenate([states["f", t], states["b", t]]) for t in range(len(own))]
        score = [float(np.tanh(q @ p["pool"] + p["pool0"]) @ p["query"]) for q in pairs]
        share = [math.exp(v - max(score)) for v in score]
        pooled = sum((a / sum(share) * q for a, q in zip(share, pairs)), np.zeros(2 * h))
        out.append(float(pooled @ p["out"] + p["out0"][0]))
    return out


def test_network_place_by_place():
    r, g = random.Random(4), np.random.default_rng(4)
    net = Network.start(np.empty(0, np.uint64), Training())
    net.p = {k: v + g.standard_normal(v.shape) * 0.2 for k, v in net.p.items()}
    texts = [" ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(n)) for n in (0, 1, 5, 32, 33, 90)]
    words, windows, text = net.encode(*_join(texts))
    want = _plain_logits(net, words, windows)
    assert np.allclose(net.forward(net.vectors(words), windows), want, atol=1e-4)
    best = [max(w for w, t in zip(want, text) if t == i) for i in range(len(texts))]
    assert np.allclose(net.scores(*_join(texts)), 1 / (1 + np.exp(-np.array(best))), atol=1e-4)


@pytest.mark.parametrize("empty", [True, False])
def test_pipeline_over_odd_tables(spark, tmp_path, empty):
    """Null ids, texts and sources, repeated rows and other columns: what passes a
    stage keeps its columns; a table without rows stays one."""
    given = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("rid", F.lit("r")).withColumn("shard", F.lit(3)).withColumn("size", F.lit("s"))
    odd = given.limit(5).withColumn("doc_id", F.lit(None).cast("long")).unionByName(given.limit(5).withColumn("text", F.lit(None).cast("string"))).unionByName(given.limit(5)).unionByName(given.limit(9).withColumn("source", F.lit(None).cast("string")))
    docs = given.unionByName(odd)
    docs = docs.where("false") if empty else docs
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SMALL}/benchmark.parquet").where(F.lit(not empty)).write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    texts = {r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        kept = {r.text for r in out.collect()}
        assert kept <= texts and bool(kept) != empty
        docs, texts = out, kept
    n = docs.count()
    placed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(placed) == n
    for s in {r.shard for r in placed}:
        assert sorted(r.slot for r in placed if r.shard == s) == list(range(sum(r.shard == s for r in placed)))
