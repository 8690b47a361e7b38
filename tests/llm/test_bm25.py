"""The index against scores of all pairs; leaks planted in documents."""

import math
import random
import re

import numpy as np
import pytest

from strandline.llm import bm25
from strandline.llm.bm25 import Decontamination, Index, contaminated_pairs, drop_contaminated, op6_bm25_decontamination, question_and_answer, terms_of
from tests.oracle import SMALL

DOCS = "doc_id long, text string, item_id string, rid string"
ITEMS = "item_id long, text string, doc_id int"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def upper(t):
    return "".join(chr(ord(c) - 32) if "a" <= c <= "z" else c for c in t)


def sentence(r, words, n):
    return " ".join(r.choice(words) for _ in range(n)).capitalize() + "."


def corpus(seed=1):
    r = random.Random(seed)
    words = ["w%d" % int(abs(r.gauss(0, 60))) for _ in range(900)] + ["é", "日本", "the"] * 40
    items = [(i, " ".join(sentence(r, words, r.randint(3, 14)) for _ in range(r.randint(1, 5))), 7) for i in range(30)]
    items += [(30, items[3][1], 7), (31, None, 7), (32, "", 7), (33, "?!", 7)]
    docs = []
    for i in range(80):
        t = [sentence(r, words, r.randint(2, 20)) for _ in range(r.randint(0, 30))]
        if i % 4 == 0:
            t.insert(r.randint(0, len(t)), upper(items[r.randrange(30)][1]).replace(" ", "  "))
        if i % 9 == 0:  # half of an item is no leak
            w = items[r.randrange(30)][1].split()
            t.insert(0, " ".join(w[: len(w) // 2]))
        docs.append((i, "\n".join(t), "x", "y"))
    return docs + [(100, None, "x", "y"), (101, "", "x", "y"), (102, "\n".join(x[1] for x in docs[:40]), "x", "y")], items


def brute_scores(texts, query):
    words = lambda t: [w for w in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower(t)) if w]
    docs = [words(t) for t in texts]
    mean = sum(map(len, docs)) / len(docs)
    out = []
    for d in docs:
        s = 0.0
        for w in set(query):
            if tf := d.count(w):
                df = sum(w in x for x in docs)
                s += math.log1p((len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
        out.append(s)
    return out


def test_wand():
    r = random.Random(5)
    docs, items = corpus()
    texts = [t or "" for _, t, _ in items]
    for ratio in (0.05, 0.3, 0.5, 0.9):
        index = Index(list(range(len(texts))), texts, Decontamination(score=ratio))
        for _ in range(60):
            q = [w for w in re.split(r"\W+", lower(r.choice(docs)[1] or "")) if w][: r.choice([5, 40, 200])]
            h, _ = terms_of([" ".join(q)])
            at = np.searchsorted(index.terms, h)
            at = np.unique(at[(at < len(index.terms)) & (index.terms[np.minimum(at, len(index.terms) - 1)] == h)])
            scores = brute_scores(texts, q)
            own = [brute_scores(texts, [w for w in re.split(r"\W+", lower(t)) if w])[i] for i, t in enumerate(texts)]
            want = {i: s for i, (s, o) in enumerate(zip(scores, own)) if o and s >= ratio * o}
            got = dict(index.search(at))
            assert set(got) == set(want)
            assert all(abs(got[i] - want[i]) < 1e-6 for i in got)


@pytest.mark.parametrize("group", [256, 7])
def test_leaks(spark, monkeypatch, group):
    monkeypatch.setattr(bm25, "GROUP", group)
    monkeypatch.setattr(bm25, "ITEMS", 20 if group == 7 else 4096)
    docs, items = corpus()
    d = spark.createDataFrame(docs, DOCS).repartition(3)
    i = spark.createDataFrame(items, ITEMS)
    norm = lambda t: " ".join(x for x in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower(t or "")) if x)
    want = {(a, b) for a, t, *_ in docs for b, x, _ in items if norm(x) and f" {norm(x)} " in f" {norm(t)} "}
    got = {(r.doc_id, r.item_id) for r in contaminated_pairs(d, i).collect()}
    long = {b for b, x, _ in items if len(norm(x).split()) >= 12}
    assert {p for p in want if p[1] in long} <= got
    assert not {p for p in got if p[1] in long} - want
    if group == 256:
        clean = drop_contaminated(d, i)
        assert clean.columns == d.columns
        assert sorted(r.doc_id for r in clean.collect()) == sorted({a for a, *_ in docs} - {a for a, _ in got})


def test_scores_do_not_depend_on_groups(spark, monkeypatch):
    """Whatever index or pass an item is in, its terms weigh the same."""
    _, items = corpus()
    i = spark.createDataFrame(items, ITEMS)

    def own():
        indexes = [x for y in bm25.build_indexes(i, Decontamination()) for x in y]
        return {(k, round(float(v), 9)) for x in indexes for k, v in zip(x.ids, x.least, strict=True)}

    whole = own()
    monkeypatch.setattr(bm25, "GROUP", 7)
    assert own() == whole
    monkeypatch.setattr(bm25, "ITEMS", 10)
    assert own() == whole


def test_pairs_do_not_depend_on_groups(spark, monkeypatch):
    docs, items = corpus()
    d, i = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS)
    # what is retrieved, and not only what the check of shingles leaves
    pairs = lambda: sorted((r.doc_id, r.item_id, r.passage, round(r.score, 9), r.question_overlap, r.answer_overlap) for r in contaminated_pairs(d, i, Decontamination(overlap=0.0)).collect())
    whole = pairs()
    assert len(whole) > 40
    for group in (64, 16, 4):
        monkeypatch.setattr(bm25, "GROUP", group)
        assert pairs() == whole


def test_tables(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    want = {(a, b) for a, t in docs.items() for b, x in items.items() if x in t}
    assert {(r.doc_id, r.item_id) for r in op6_bm25_decontamination(spark, SMALL).collect()} == want


def test_parts_and_empty(spark):
    assert question_and_answer("What is it? It is a bird, and so on.") == ("What is it? ", "It is a bird, and so on.")
    assert question_and_answer("Why?\nAnswer: so") == ("Why?", " so")
    assert question_and_answer("one two three four five six seven eight") == ("one two three four five six ", "seven eight")
    none_d, none_i = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    d, i = spark.createDataFrame([(None, "a b c d e f", "", ""), (1, "x", "", ""), (1, "x", "", "")], DOCS), spark.createDataFrame([(1, "a b c d e f", 1)], ITEMS)
    assert contaminated_pairs(none_d, i).collect() == [] == contaminated_pairs(d, none_i).collect()
    assert [(r.doc_id, r.item_id) for r in contaminated_pairs(d, i).collect()] == [(None, 1)]
    assert drop_contaminated(d, i).count() == 2 and drop_contaminated(d, none_i).count() == 3
