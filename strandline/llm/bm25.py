"""Benchmark decontamination: a BM25 inverted index of test items, queried with
every training passage by block-max WAND, and a check of question and answer."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import frees, give_back_key, keyed_rows, pieces, text_buffer
from ._symbols import window_hashes, word_hashes, word_spans

K1, B = 1.2, 0.75
BLOCK = 8  # items in a block of a postings list
GROUP = 256  # items in one index
ITEMS = 4096  # items that go to the tasks at once; more take further passes


@dataclass(frozen=True)
class Decontamination:
    """score: least BM25 score of a passage, as a share of the score that the
    item's own text has. overlap: least share of the question's and of the
    answer's shingles that the document has around the passage."""

    score: float = 0.5
    overlap: float = 0.7
    shingle: int = 5


def terms_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lowered terms of all texts, and where each text's begin."""
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    buf = np.frombuffer(b"".join(raw), np.uint8)
    ws, we, first = word_spans(off, buf, terms=True)
    return word_hashes(buf, ws, we, lower=True), first


def question_and_answer(text: str) -> tuple[str, str]:
    """An explicit answer mark divides an item; otherwise its last sentences do,
    as many as hold a quarter of its words."""
    if m := re.search(r"\n\s*(?:answer|a)\s*:", text, re.IGNORECASE):
        return text[: m.start()], text[m.end() :]
    least, n = max(1, len(text.split()) // 4), len(text)
    for m in reversed(list(re.finditer(r"[.!?]\s+", text))):
        if len(text[m.end() :].split()) >= least and text[: m.start()].split():
            n = m.end()
            break
    if n == len(text):  # one sentence
        cut = [m.start() for m in re.finditer(r"\S+", text)]
        n = cut[len(cut) - least] if len(cut) > least else len(text)
    return text[:n], text[n:]


@dataclass(frozen=True, eq=False)
class Counts:
    """What scores and passages take from the whole benchmark: items that have a
    term, by its hash; number of items; their terms; terms of the longest."""

    terms: np.ndarray
    df: np.ndarray
    items: int
    length: int
    longest: int

    @staticmethod
    def of(texts: list[str]) -> Counts:
        hashes, first = terms_of(texts)
        item = np.repeat(np.arange(len(texts)), np.diff(first))
        terms, term = np.unique(hashes, return_inverse=True)
        pair = np.unique(term.astype(np.int64) * max(len(texts), 1) + item)
        return Counts(terms, np.bincount(pair // max(len(texts), 1), minlength=len(terms)), len(texts), len(hashes), int(np.diff(first).max(initial=0)))

    def __add__(self, other: Counts) -> Counts:
        terms, at = np.unique(np.concatenate([self.terms, other.terms]), return_inverse=True)
        df = np.zeros(len(terms), np.int64)
        np.add.at(df, at, np.concatenate([self.df, other.df]))
        return Counts(terms, df, self.items + other.items, self.length + other.length, max(self.longest, other.longest))


class Index:
    """Postings of up to GROUP items: by term, items in order with their scores,
    and the largest score in each block of items. Scores are by the counts of
    all items; without any, by those of its own."""

    def __init__(self, ids: list, texts: list[str], options: Decontamination, counts: Counts | None = None):
        self.ids, self.options = ids, options
        hashes, first = terms_of(texts)
        n = np.diff(first)
        item = np.repeat(np.arange(len(texts)), n)
        self.terms, term = np.unique(hashes, return_inverse=True)
        pair, tf = np.unique(term.astype(np.int64) * len(texts) + item, return_counts=True)
        term, item = pair // max(len(texts), 1), pair % max(len(texts), 1)
        df = np.bincount(term, minlength=len(self.terms))
        counts = counts or Counts.of(texts)
        all_df = counts.df[np.searchsorted(counts.terms, self.terms)]
        idf = np.log1p((counts.items - all_df + 0.5) / (all_df + 0.5))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n[item] / max(counts.length / max(counts.items, 1), 1e-9)))
        self.item, self.weight = item, weight
        self.at = np.concatenate([[0], np.cumsum(df)])
        own = np.bincount(item, weights=weight, minlength=len(texts))
        self.least = options.score * own
        self.least[own == 0] = np.inf
        blocks = -(-len(texts) // BLOCK)
        self.block_least = np.array([self.least[b * BLOCK : (b + 1) * BLOCK].min() for b in range(blocks)])
        self.block_most = np.zeros((len(self.terms) + 1, blocks), np.float32)
        np.maximum.at(self.block_most, (term, item // BLOCK), weight)
        # float32 may have rounded a bound down
        self.block_most = np.nextafter(self.block_most, np.float32(np.inf), where=self.block_most > 0, out=self.block_most)
        self.longest = counts.longest
        # terms in more than `few` items can't lift an item to its threshold by
        # themselves: what they add to it at most is taken off, and the postings
        # of the others decide which items a passage may reach
        self.few, few = 1, 1
        while True:
            rest = np.bincount(item, weights=np.where(df[term] > few, weight, 0.0), minlength=len(texts))
            self.few, self.need = few, np.where(own == 0, np.inf, self.least - rest)
            if few >= len(texts) or (self.need >= 0.35 * self.least)[own > 0].all():
                break
            few *= 2
        self.df = np.append(df, len(texts) + 1)
        parts = [question_and_answer(t) for t in texts]
        self.parts = [tuple(self._shingles(h[f[i] : f[i + 1]]) for i in range(2)) for h, f in (terms_of(list(p)) for p in parts)]

    def _shingles(self, h: np.ndarray) -> tuple[int, np.ndarray]:
        k = self.options.shingle if len(h) >= 2 * self.options.shingle else max(1, min(3, len(h)))
        return k, np.unique(window_hashes(h, k))

    def search(self, query: np.ndarray) -> list[tuple[int, float]]:
        """All items whose score with the query's distinct terms reaches their
        threshold, by block-max WAND."""
        lists = [[int(self.at[t]), int(self.at[t + 1]), float(self.weight[self.at[t] : self.at[t + 1]].max()), int(t)] for t in query]
        least, found = float(self.least.min()), []
        item, weight = self.item, self.weight
        while True:
            lists = [x for x in lists if x[0] < x[1]]
            lists.sort(key=lambda x: item[x[0]])
            bound, pivot = 0.0, None
            for i, x in enumerate(lists):
                bound += x[2]
                if bound * (1 + 1e-9) >= least:
                    pivot = i
                    break
            if pivot is None:
                return found
            at = int(item[lists[pivot][0]])
            while pivot + 1 < len(lists) and item[lists[pivot + 1][0]] == at:
                pivot += 1
            block = at // BLOCK
            most = sum(float(self.block_most[x[3], block]) for x in lists[: pivot + 1])
            if most * (1 + 1e-6) < self.block_least[block]:
                # nothing in this block up to where the next list sets in
                to = (block + 1) * BLOCK
                if pivot + 1 < len(lists):
                    to = min(to, int(item[lists[pivot + 1][0]]))
                for x in lists[: pivot + 1]:
                    x[0] += int(np.searchsorted(item[x[0] : x[1]], to))
            elif item[lists[0][0]] == at:
                # exactly rounded, so that the order of the lists changes nothing
                score = math.fsum(weight[x[0]] for x in lists[: pivot + 1])
                for x in lists[: pivot + 1]:
                    x[0] += 1
                if score >= self.least[at] * (1 - 1e-9):
                    found.append((at, score))
            else:
                for x in lists[:pivot]:
                    if item[x[0]] < at:
                        x[0] += int(np.searchsorted(item[x[0] : x[1]], at))

    def verified(self, region: np.ndarray, at: int) -> tuple[float, float]:
        """Shares of the question's and the answer's shingles in the region."""
        out = []
        for k, s in self.parts[at]:
            out.append(1.0 if not len(s) else float(np.isin(s, window_hashes(region, k)).mean()))
        return out[0], out[1]


def _reach(index: Index, term, first, text, count, stride, end) -> np.ndarray:
    """Whether a passage may reach some item: WAND's pivot test for all passages
    of a run at once, over the postings of the rarer terms. Exact: whatever a
    search would find passes."""
    n = len(index.ids)
    at = np.flatnonzero(index.df[term] <= index.few)
    own = np.searchsorted(first, at, side="right") - 1
    begin = np.cumsum(count) - count
    step = (at - first[own]) // stride
    keys = []
    for k in range(-(-index.longest // stride) + 1):
        number = np.minimum(step, count[own] - 1) - k
        passage = begin[own] + number
        inside = (number >= 0) & (at < end[np.maximum(passage, 0)])
        keys.append(passage[inside] * len(index.df) + term[at[inside]])
    key = np.unique(np.concatenate(keys))
    passage, t = key // len(index.df), key % len(index.df)
    size = index.df[t]
    posting = np.arange(int(size.sum())) + np.repeat(index.at[t] - (np.cumsum(size) - size), size)
    score = np.bincount(np.repeat(passage, size) * n + index.item[posting], weights=index.weight[posting], minlength=len(text) * n)
    return (score.reshape(len(text), n) * (1 + 1e-9) + 1e-9 >= index.need).any(axis=1)


def scan(indexes: list[Index], off: np.ndarray, buf: np.ndarray) -> dict[tuple[int, object], tuple[int, float, float, float]]:
    """(text, item id) -> (first term of the best passage, its score, overlap
    with question, with answer), for the contaminated pairs of a run of texts."""
    ws, we, first = word_spans(off, buf, terms=True)
    h = word_hashes(buf, ws, we, lower=True)
    out: dict[tuple[int, object], tuple[int, float, float, float]] = {}
    n = np.diff(first)
    for index in indexes:
        if not len(index.terms):
            continue
        stride = max(16, index.longest // 2)
        width = index.longest + stride  # holds any item whole, wherever it stands
        count = np.where(n > 0, np.maximum(1, -(-(n - width) // stride) + 1), 0)
        text = np.repeat(np.arange(len(n)), count)
        start = first[text] + (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * stride
        end = np.minimum(start + width, first[text + 1])
        at = np.minimum(np.searchsorted(index.terms, h), len(index.terms) - 1)
        term = np.where(index.terms[at] == h, at, len(index.terms))
        for i in np.flatnonzero(_reach(index, term, first, text, count, stride, end)).tolist():
            query = np.unique(term[start[i] : end[i]])
            for item, score in index.search(query[query < len(index.terms)]):
                t = int(text[i])
                key = (t, index.ids[item])
                if key in out and out[key][1] >= score:
                    continue
                region = h[max(first[t], start[i] - index.longest) : min(first[t + 1], end[i] + index.longest)]
                question, answer = index.verified(region, item)
                if min(question, answer) >= index.options.overlap:
                    out[key] = (int(start[i] - first[t]), score, question, answer)
    return out


def build_indexes(items: DataFrame, options: Decontamination) -> Iterator[list[Index]]:
    """Indexes of at most ITEMS items, one list after another: what the driver
    and the tasks hold is bounded, however many test items there are, but for
    the terms' counts, which are those of all items."""
    rows = items.select(F.col("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = max(1, -(-rows.count() // ITEMS))
    read = lambda b: sorted(rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect(), key=lambda r: (r.item_id is None, r.item_id or 0, r.text))
    first = read(0)
    counts = Counts.of([r.text for r in first])
    for b in range(1, blocks):
        counts += Counts.of([r.text for r in read(b)])
    for b in range(blocks):
        own = read(b) if b else first
        yield [Index([r.item_id for r in own[a : a + GROUP]], [r.text for r in own[a : a + GROUP]], options, counts) for a in range(0, len(own), GROUP)]


PAIRS = "rid long, item_id long, passage long, score double, question_overlap double, answer_overlap double"


@frees
def _scan_pairs(indexes: list[Index], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in PAIRS.split(", ")]
    types = [pa.int64()] * 3 + [pa.float64()] * 3
    for batch in batches:
        for rid, off, buf in pieces(batch, 0, 1, 1 << 20):
            rows = [(int(rid[t]), item, *x) for (t, item), x in scan(indexes, off, buf).items()]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def contaminated_pairs(docs: DataFrame, items: DataFrame, options: Decontamination = Decontamination()) -> DataFrame:
    """Which documents hold which test items.

    Terms are runs of letters, digits and non-ASCII characters, A-Z lowered.
    Every passage of every whole text is a query: passages are as long as the
    longest item plus half of that, and start that half apart, so each place
    where an item can stand lies within one. An item is retrieved
    where its score reaches `score` of what its own text scores, and reported
    where the shingles of its question and of its answer are found in the
    document, within an item's length around the passage.

    Returns doc_id, item_id, passage (number of its first term), score,
    question_overlap, answer_overlap: the best passage of each contaminated
    pair. Null or empty texts hold nothing, null or empty items are held by
    nothing; items with the same text are each reported. Rows are judged one by
    one: where doc_id repeats or is null each row gives its own pairs. Empty
    tables give none; other columns are ignored.
    """
    rows, same = keyed_rows(docs)
    found = None
    for indexes in build_indexes(items, options):
        part = rows.select("rid", "text").mapInArrow(partial(_scan_pairs, indexes), PAIRS)
        found = part if found is None else found.unionAll(part)
    return give_back_key(found, rows, same)


@frees
def _keep_clean(indexes: list[Index], column: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        off, buf = text_buffer(batch.column(batch.schema.get_field_index(column)))
        dirty = np.zeros(len(off) - 1, bool)
        a = 0
        while a < len(dirty):
            b = max(a + 1, int(np.searchsorted(off, off[a] + (1 << 20), side="right")) - 1)
            for t, _ in scan(indexes, off[a : b + 1] - off[a], buf[off[a] : off[b]]):
                dirty[a + t] = True
            a = b
        yield batch.filter(pa.array(~dirty))


def drop_contaminated(docs: DataFrame, items: DataFrame, options: Decontamination = Decontamination()) -> DataFrame:
    """The rows that hold no test item, with the columns they came with, whatever
    their names. Each row is judged for itself, so repeated rows and null ids are
    no special case; null and empty texts hold nothing and are kept; without test
    items, or with null and empty ones alone, every row is kept."""
    for indexes in build_indexes(items, options):
        docs = docs.mapInArrow(partial(_keep_clean, indexes, "text"), docs.schema)
    return docs


def op6_bm25_decontamination(spark, sf_dir):
    """Contaminated pairs of all documents and all test items, figures to six places."""
    out = contaminated_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.withColumns({c: F.round(c, 6) for c in ("score", "question_overlap", "answer_overlap")})
