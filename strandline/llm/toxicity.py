"""Toxicity by a bidirectional gated recurrent network with attention pooling,
over word and character inputs, trained and run in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import mix64, pieces
from ._symbols import _LOWER, word_hashes, word_spans

FOLDS = 5  # rows whose crc32(doc_id as text) is divisible by this are held out


@dataclass(frozen=True)
class Training:
    """positives, negatives: most labelled rows of each class that are read, by
    the order of a hash of their numbers; longest: bytes of a text above which a
    row is not trained on. These bound what the driver holds. common: training
    texts that a word must be in to have an input of its own."""

    positives: int = 1500
    negatives: int = 2000
    longest: int = 1 << 16
    common: int = 3
    epochs: int = 6
    rate: float = 0.02
    decay: float = 1e-4
    seed: int = 5
    window: int = 32
    stride: int = 16


@dataclass
class Network:
    """words: sorted hashes of the words that have an input. p: the weights."""

    words: np.ndarray
    p: dict[str, np.ndarray]
    window: int
    stride: int
    hidden: int = 8
    slots: int = 4096
    cache: dict = field(default_factory=dict, repr=False)

    @classmethod
    def start(cls, words: np.ndarray, how: Training, word: int = 8, char: int = 8, hidden: int = 8, slots: int = 4096) -> Network:
        r = np.random.default_rng(how.seed)
        f = lambda *shape, s=0.3: (r.standard_normal(shape) * s).astype(np.float32)
        z = lambda *shape: np.zeros(shape, np.float32)
        d, h = word + char, hidden
        p = {"word": f(len(words) + 1, word, s=0.1), "char": f(slots, char, s=0.1), "pool": f(2 * h, h), "pool0": z(h), "query": f(h), "out": f(2 * h), "out0": np.full(1, -1.0, np.float32)}
        for k in "fb":
            p |= {f"w{k}": f(d, 3 * h), f"b{k}": z(3 * h), f"u{k}": f(h, 3 * h), f"c{k}": z(3 * h)}
        return cls(words, p, how.window, how.stride, hidden, slots)

    # -- inputs -----------------------------------------------------------------

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, len(self.words))

    def encode(self, off: np.ndarray, buf: np.ndarray):
        """A run of texts as distinct words and windows over them: (word ids,
        character slots, word of each slot; windows of numbers of distinct
        words, -1 behind a text's end; text of each window). Every text has a
        window at least; windows overlap and cover the whole text."""
        ws, we, first = word_spans(off, buf, terms=True)
        h = word_hashes(buf, ws, we, lower=True)
        distinct, at, ids = np.unique(h, return_index=True, return_inverse=True)
        s, e = ws[at], we[at]
        # character trigrams of each distinct word, its ends marked by zeros
        size = e - s + 2
        which = np.repeat(np.arange(len(s)), np.maximum(size - 2, 0))
        where = np.arange(len(which)) - np.repeat(np.cumsum(size - 2) - (size - 2), size - 2)
        low = _LOWER[buf] if len(buf) else buf
        byte = lambda i: np.where((i >= 0) & (i < (e - s)[which]), low[np.clip(s[which] + i, 0, max(len(low) - 1, 0))], 0).astype(np.uint64) if len(which) else np.empty(0, np.uint64)
        grams = byte(where - 1) << np.uint64(16) | byte(where) << np.uint64(8) | byte(where + 1)
        slot = (mix64(grams) % np.uint64(self.slots)).astype(np.int64)
        n = np.diff(first)
        count = np.maximum(1, -(-(n - self.window) // self.stride) + 1)
        text = np.repeat(np.arange(len(n)), count)
        start = first[text] + (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * self.stride
        place = start[:, None] + np.arange(self.window)
        inside = place < first[text + 1][:, None]
        windows = np.where(inside, ids[np.where(inside, place, 0)], -1) if len(ids) else np.full(place.shape, -1)
        return (self.lookup(distinct), slot, which, len(distinct)), windows, text

    def vectors(self, words) -> np.ndarray:
        """The input of each distinct word: its own vector, and the mean of those
        of its character trigrams."""
        ids, slot, which, n = words
        chars = np.zeros((n, self.p["char"].shape[1]), np.float32)
        if n:
            begin = np.searchsorted(which, np.arange(n))
            size = np.diff(np.append(begin, len(which)))
            chars = np.add.reduceat(self.p["char"][slot], begin, axis=0) / size[:, None]
        return np.concatenate([self.p["word"][ids], chars.astype(np.float32)], axis=1)

    # -- forward and back -----------------------------------------------------------

    def forward(self, x: np.ndarray, windows: np.ndarray, keep: bool = False):
        """Logits of windows; x: vectors of distinct words. Inputs are projected
        once for each distinct word, not for each place."""
        p, h = self.p, self.hidden
        n, steps = windows.shape
        mask = windows >= 0
        states, trace = np.zeros((steps, n, 2 * h), np.float32), {}
        for k, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            gate = np.concatenate([x @ p[f"w{k}"] + p[f"b{k}"], np.zeros((1, 3 * h), np.float32)])
            s = np.zeros((n, h), np.float32)
            own = slice(0, h) if k == "f" else slice(h, 2 * h)
            for t in order:
                gx = gate[windows[:, t]]
                gh = s @ p[f"u{k}"] + p[f"c{k}"]
                rz = _sigmoid(gx[:, : 2 * h] + gh[:, : 2 * h])
                r, z = rz[:, :h], rz[:, h:]
                new = _tanh(gx[:, 2 * h :] + r * gh[:, 2 * h :])
                m = mask[:, t : t + 1]
                out = np.where(m, new + z * (s - new), s)
                if keep:
                    trace[k, t] = (s, r, z, new, gh[:, 2 * h :], m)
                s = out
                states[t, :, own] = s
        tops = _tanh(states @ p["pool"] + p["pool0"])
        score = np.where(mask.T, tops @ p["query"], np.float32(-1e9))
        score -= score.max(axis=0)
        a = np.exp(score) * mask.T
        a /= np.maximum(a.sum(axis=0), 1e-9)
        pooled = np.einsum("tn,tnh->nh", a, states)
        logit = pooled @ p["out"] + p["out0"][0]
        return (logit, (trace, states, tops, a, pooled)) if keep else logit

    def gradients(self, words, windows: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, h = self.p, self.hidden
        x = self.vectors(words)
        logit, (trace, states, tops, a, pooled) = self.forward(x, windows, keep=True)
        n, steps = windows.shape
        d = ((_sigmoid(logit) - label) * weight / weight.sum()).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["out"], g["out0"] = pooled.T @ d, np.array([d.sum()], np.float32)
        d_pool = d[:, None] * p["out"]
        d_states = a[:, :, None] * d_pool
        d_a = np.einsum("nh,tnh->tn", d_pool, states)
        d_score = a * (d_a - (a * d_a).sum(axis=0))
        g["query"] = np.einsum("tn,tnh->h", d_score, tops)
        d_top = d_score[:, :, None] * p["query"] * (1 - tops**2)
        g["pool"], g["pool0"] = np.einsum("tnh,tnk->hk", states, d_top), d_top.sum(axis=(0, 1))
        d_states = d_states + d_top @ p["pool"].T
        d_x = np.zeros((len(x) + 1, x.shape[1]), np.float32)
        for k, order in (("f", range(steps - 1, -1, -1)), ("b", range(steps))):
            own = slice(0, h) if k == "f" else slice(h, 2 * h)
            back = np.zeros((n, h), np.float32)
            d_gate = np.zeros((len(x) + 1, 3 * h), np.float32)
            for t in order:
                s, r, z, new, gn, m = trace[k, t]
                full = back + d_states[t][:, own]
                on = np.where(m, full, 0)
                d_new = on * (1 - z) * (1 - new**2)
                d_z = on * (s - new) * z * (1 - z)
                d_r = d_new * gn * r * (1 - r)
                d_h = np.concatenate([d_r, d_z, d_new * r], axis=1)
                g[f"u{k}"] += s.T @ d_h
                g[f"c{k}"] += d_h.sum(axis=0)
                np.add.at(d_gate, windows[:, t], np.concatenate([d_r, d_z, d_new], axis=1))
                back = np.where(m, on * z, full) + d_h @ p[f"u{k}"].T
            d_gate[-1] = 0
            g[f"w{k}"] += x.T @ d_gate[:-1]
            g[f"b{k}"] += d_gate[:-1].sum(axis=0)
            d_x[:-1] += d_gate[:-1] @ p[f"w{k}"].T
        ids, slot, which, count = words
        dim = p["word"].shape[1]
        np.add.at(g["word"], ids, d_x[:-1, :dim])
        if count:
            size = np.bincount(which, minlength=count)
            np.add.at(g["char"], slot, (d_x[:-1, dim:] / size[:, None])[which])
        return g

    def scores(self, off: np.ndarray, buf: np.ndarray, most: int = 4096) -> np.ndarray:
        """The largest probability of any window of each text."""
        words, windows, text = self.encode(off, buf)
        x = self.vectors(words)
        logit = np.concatenate([self.forward(x, windows[a : a + most]) for a in range(0, len(windows), most)]) if len(windows) else np.empty(0)
        out = np.full(len(off) - 1, -np.inf)
        np.maximum.at(out, text, logit)
        return _sigmoid(out)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _tanh(x):
    return 1 - 2 / (1 + np.exp(np.clip(2 * x, -30, 30)))


def _join(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64), np.frombuffer(b"".join(raw), np.uint8)


def train(texts: list[str], labels: np.ndarray, how: Training = Training()) -> Network:
    """Fit on whole texts: a text's label is that of its most toxic window, so in
    each epoch every text gives the window that scores highest just now."""
    off, buf = _join(texts)
    ws, we, first = word_spans(off, buf, terms=True)
    h = word_hashes(buf, ws, we, lower=True)
    if len(h):
        pair = np.unique(np.stack([h, np.repeat(np.arange(len(texts)), np.diff(first)).astype(np.uint64)]), axis=1)[0]
        known, count = np.unique(pair, return_counts=True)
        known = known[count >= how.common]
    else:
        known = h
    net = Network.start(known, how)
    if not len(texts) or labels.min() == labels.max():
        # nothing to tell apart: the share of label 1, whatever the text
        share = float(np.clip(labels.mean(), 0.001, 0.999)) if len(texts) else 0.001
        net.p["out"][:] = 0
        net.p["out0"][0] = np.log(share / (1 - share))
        return net
    words, windows, text = net.encode(off, buf)
    rng = np.random.default_rng(how.seed)
    begin = np.searchsorted(text, np.arange(len(texts)))
    weight = np.where(labels == 1, 0.5 / max((labels == 1).mean(), 1e-9), 0.5 / max((labels == 0).mean(), 1e-9)).astype(np.float32)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    for epoch in range(how.epochs):
        if epoch:
            x = net.vectors(words)
            logit = np.concatenate([net.forward(x, windows[a : a + 4096]) for a in range(0, len(windows), 4096)])
            order = np.lexsort((-logit, text))
            chosen = order[begin]
            # of other windows some, so that negatives are seen beyond their worst
            some = rng.integers(0, len(text), len(texts))
            some = some[labels[text[some]] == 0]
        else:
            # at first as many windows of each text as it may need
            some = rng.permutation(len(text))[: 6 * len(texts)]
            chosen = begin
        rows = rng.permutation(np.concatenate([chosen, some]))
        rate = how.rate * (1 - epoch / how.epochs)
        for a in range(0, len(rows), 128):
            own = rows[a : a + 128]
            used, local = np.unique(windows[own], return_inverse=True)
            local = local.reshape(windows[own].shape)
            if used[0] == -1:
                used, local = used[1:], local - 1
            g = net.gradients(_subset(words, used), local, labels[text[own]], weight[text[own]])
            step += 1
            for k, v in net.p.items():
                m, s = moment[k]
                m += 0.1 * (g[k] - m)
                s += 0.001 * (g[k] ** 2 - s)
                v -= rate * (m / (1 - 0.9**step) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8) + how.decay * v)
    net.p["out0"] += _shift(net, words, windows, begin, text, labels)
    return net


def _subset(words, used: np.ndarray):
    """The distinct words numbered in `used`, numbered anew."""
    ids, slot, which, n = words
    a, b = np.searchsorted(which, used), np.searchsorted(which, used, side="right")
    size = b - a
    at = np.arange(int(size.sum())) + np.repeat(a - (np.cumsum(size) - size), size)
    return ids[used], slot[at], np.repeat(np.arange(len(used)), size), len(used)


def _shift(net: Network, words, windows, begin, text, labels) -> np.float32:
    """Move the outputs so that a half parts the training texts as well as can
    be (the classes were weighted alike), within two units of the logit."""
    x = net.vectors(words)
    logit = np.concatenate([net.forward(x, windows[a : a + 4096]) for a in range(0, len(windows), 4096)])
    top = np.maximum.reduceat(logit, begin)
    cuts = np.linspace(-2, 2, 81)
    right = [((top > c) == (labels == 1)).sum() for c in cuts]
    best = np.flatnonzero(np.array(right) == max(right))
    return np.float32(-cuts[best[len(best) // 2]])


def held_out(doc_id) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0


def fit(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> Network:
    """Train on labelled rows outside the held-out part, a bounded sample. Of
    several labels or texts of one doc_id each pair counts."""
    usable = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("of"), "toxic")
    picked = [usable.where(F.col("toxic") == c).orderBy(F.xxhash64("of"), "of").limit(n) for c, n in ((1, how.positives), (0, how.negatives))]
    picked = F.broadcast(picked[0].unionAll(picked[1]))  # positives + negatives rows at most
    short = docs.where(F.octet_length("text") <= how.longest).select("doc_id", "text")
    rows = sorted(short.join(picked, F.col("doc_id") == F.col("of")).select("text", "toxic", "doc_id").collect(), key=lambda r: (r.doc_id, r.toxic, r.text))
    return train([r.text for r in rows], np.array([r.toxic for r in rows], np.float32), how)


def _score(net: Network, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a = 0
        for rid, off, buf in pieces(batch, 2, 1, 1 << 19):
            yield pa.record_batch([batch.column(0).slice(a, len(rid)), pa.array(net.scores(off, buf).astype(np.float64))], names=["doc_id", "score"])
            a += len(rid)


def toxicity_scores(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on), for each row.

    A text is terms (runs of letters, digits and non-ASCII characters, A-Z
    lowered); windows of them overlap by half and cover the whole text, and its
    score is that of its most toxic window. A null or empty text has one window
    without terms. Rows are scored one by one, so ties, repeated rows and null
    ids make no difference; an empty table gives none. Only the text goes into a
    score, no other column.
    """
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.lit(0).cast("long").alias("zero"))
    out = one.mapInArrow(partial(_score, net), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_attention_toxicity(spark, sf_dir):
    """Train on labelled documents, score all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return toxicity_scores(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
