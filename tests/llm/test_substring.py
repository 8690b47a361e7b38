"""Substring removal against brute force over all positions."""

import hashlib
import random

import numpy as np
import pytest

from strandline.llm.deepshallow import suffix_order
from strandline.llm.substring import suffix_array_dedup, suffix_tree_dedup
from strandline.llm.suffixtree import repeats

SCHEMA = "doc_id long, text string, h int, kept string"


def brute_bytes(rows, length):
    seen, out = set(), []
    for doc, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int(gone[:1].sum()) + int((np.diff(gone.astype(int)) == 1).sum())
        out.append((doc, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def brute_words(rows, length):
    seen, out = {}, []
    for n, (doc, text) in enumerate(rows):
        w = (text or "").encode().split()
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - length + 1):
            if seen.setdefault(tuple(w[i : i + length]), n) != n:
                gone[i : i + length] = True
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc, len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    words = ["a", "bé", "cc", "dog", "e,", "fü", "<x>", "日本"] + ["w%d" % i for i in range(300)]
    base = [" ".join(r.choice(words) for _ in range(r.randint(0, 160))) for _ in range(n)]
    rows = []
    for i, t in enumerate(base):
        k = r.random()
        if k < 0.2:
            t = r.choice(base)
        elif k < 0.5:
            o = r.choice(base)
            a = r.randint(0, len(o))
            t = t[: r.randint(0, len(t))] + o[a : a + r.randint(0, 900)] + "\n\t" + t[-50:]
        elif k < 0.6:
            t = t + " " + t
        elif k < 0.65:
            t = "ab" * r.randint(10, 400)
        rows.append((i * 3, t))
    rows += [(1000, None), (1001, ""), (1002, "x " * 500), (1003, "x " * 700), (1004, "z" * 5000)]
    common = "the common line that opens very many of all documents in here every day " * 2
    rows += [(2000 + i, common + " ".join(r.choice(words) for _ in range(60))) for i in range(40)]
    return rows


def frame(spark, rows):
    r = list(rows)
    random.Random(1).shuffle(r)
    return spark.createDataFrame([(d, t, 1, "x") for d, t in r], SCHEMA).repartition(3)


def got_bytes(df):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in df.collect())


@pytest.mark.parametrize("seed,length", [(1, 100), (2, 40)])
def test_bytes(spark, seed, length):
    rows = corpus(seed)
    assert got_bytes(suffix_array_dedup(frame(spark, rows), length)) == sorted(brute_bytes(rows, length))


@pytest.mark.parametrize("seed,length", [(3, 50), (4, 9)])
def test_words(spark, seed, length):
    rows = corpus(seed)
    out = suffix_tree_dedup(frame(spark, rows), length).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out) == sorted(brute_words(rows, length))


def test_same_and_null_ids(spark):
    t = "some text that is long enough to be found again, in another row of the same number, " * 2
    rows = [(None, t), (None, t), (1, t), (1, t + "more"), (1, None)]
    out = suffix_array_dedup(frame(spark, rows), 100).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    key = lambda r: (str(r[0]),) + r[1:]
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out), key=key) == sorted(brute_bytes(order, 100), key=key)


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert suffix_array_dedup(empty).collect() == []
    assert suffix_tree_dedup(empty).collect() == []


def test_kernels():
    rng = np.random.default_rng(0)
    for trial in range(60):
        length = int(rng.integers(8, 60))
        n = int(rng.integers(length, 300))
        buf = rng.integers(97, 97 + rng.integers(1, 4), n).astype(np.uint8)
        if trial % 3 == 0:
            buf = np.tile(buf[: max(1, n // 5)], 7)[:n]
        pos, b = np.arange(n - length + 1), buf.tobytes()
        order, same = suffix_order(buf, pos, length, shallow=int(rng.choice([8, 16, 32])))
        keys = [b[p : p + length] for p in pos[order]]
        assert keys == sorted(keys)
        assert [False] + [x == y for x, y in zip(keys, keys[1:])] == list(same)
        leaves, nodes = repeats(np.append(buf, np.zeros(length)).astype(np.int64), pos, length, int(rng.integers(2, 50)))
        want, found = {}, {}
        for p in pos:
            want.setdefault(b[p : p + length], set()).add(int(p))
        for leaf, node in zip(leaves, nodes):
            found.setdefault(int(node), set()).add(int(pos[leaf]))
        assert sorted(map(sorted, found.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_wholes():
    """Suffixes of several groups, each with a length of its own, under hashes
    that say nothing: the sort and the tree decide."""
    from strandline.llm._repeats import Repeats, _collapse, _select
    from strandline.llm.substring import _whole_bytes, _whole_words

    rng = np.random.default_rng(3)
    for trial in range(20):
        n = 120
        sizes = rng.choice([34, 41, 60], n)
        own = [rng.integers(97, 99, s).astype(np.uint8) for s in sizes]
        for i in range(0, n, 2):
            j = int(rng.integers(0, n))
            own[i] = own[j].copy()
            if trial % 2:
                own[i][int(rng.integers(0, len(own[i])))] ^= 1
        word = trial % 4 > 1
        if word:  # one word for each symbol, with other separators in each copy
            texts = [b" " * int(rng.integers(1, 3)) + (b" " if i % 2 else b"\n").join(b"word%d" % c for c in x) for i, x in enumerate(own)]
            texts = [t.strip() for t in texts]
        else:
            texts = [x.tobytes() for x in own]
        off = np.cumsum([0] + [len(t) for t in texts]).astype(np.int64)
        buf = np.frombuffer(b"".join(texts), np.uint8)
        rid = rng.integers(0, 20, n)
        place = np.arange(n) << 8 | np.array([len(x) - 33 for x in own])
        job = Repeats("word" if word else "byte", 34, 8, bool(trial % 3), None, _whole_words if word else _whole_bytes)
        got = _collapse(job, np.zeros(n, np.uint64), rid, place, lambda rows: _select(rows, off, buf))
        first = {}
        for i in sorted(range(n), key=lambda i: (rid[i], place[i])):
            j = first.setdefault(own[i].tobytes(), i)
            assert got[i] == ((rid[i] != rid[j]) if job.between else i != j)


def test_word_numbers():
    from strandline.llm import _symbols

    texts = [b"a", b"a", b"ab", b"abcdefgh", b"abcdefgh", b"abcdefghi", b"abcdefghj", b"x" * 5000, b"x" * 5000, b"x" * 4999 + b"y", b"ab"]
    buf = np.frombuffer(b" ".join(texts), np.uint8)
    ws, we, _ = _symbols.word_spans(np.array([0, len(buf)]), buf)
    plain = _symbols.word_hashes
    for hashes in (plain, lambda *a: np.zeros(len(texts), np.uint64)):
        _symbols.word_hashes = hashes
        try:
            got = _symbols.word_numbers(buf, ws, we).tolist()
        finally:
            _symbols.word_hashes = plain
        assert [got.index(x) for x in got] == [texts.index(x) for x in texts]
