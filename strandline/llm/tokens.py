"""Token counts of fields and sections by offset-mapped attribution."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the pre-tokenizer pattern that the vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
RULES = ("first", "last", "most", "split")
_loaded: dict[tuple[str, str], tuple] = {}


@dataclass(frozen=True)
class Attribution:
    """vocabulary: path of a file of ranks, on every machine. fields: columns of
    a document, joined by `joiner` and encoded as one text. lines: whether each
    line of a field is a section, or each field one.

    rule, for tokens that cross a boundary between sections: `first` gives the
    token to the section of its first byte, `last` to that of its last one,
    `most` to the one with most of its bytes (the earlier of equals), `split`
    gives each section the part of the token that its bytes are.
    A section holds the newline or joiner that ends it."""

    vocabulary: str = VOCABULARY
    pattern: str = PATTERN
    fields: tuple[str, ...] = ("text",)
    joiner: str = "\n"
    lines: bool = True
    rule: str = "first"


def encoding(a: Attribution):
    """The tokenizer and the byte length of each token; one for each process."""
    key = (a.vocabulary, a.pattern)
    if key not in _loaded:
        import tiktoken

        with open(a.vocabulary, "rb") as f:
            ranks = {base64.b64decode(t): int(n) for t, n in map(bytes.split, f)}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for t, n in ranks.items():
            size[n] = len(t)
        _loaded[key] = tiktoken.Encoding("ranks", pat_str=a.pattern, mergeable_ranks=ranks, special_tokens={}), size
    return _loaded[key]


def sections_of(a: Attribution, values: list[str | None]) -> tuple[str, list[int], np.ndarray]:
    """The joined text, the field of each section, and the byte offsets at which
    sections begin, with the end of the text behind them."""
    field, start, at = [], [], 0
    texts = [v or "" for v in values]
    for i, t in enumerate(texts):
        body = t.encode()
        if i + 1 < len(texts):
            body += a.joiner.encode()
        begins = [0]
        if a.lines:
            inner = np.flatnonzero(np.frombuffer(t.encode(), np.uint8) == 10) + 1
            begins += [int(x) for x in inner if x < len(body)]
        field += [i] * len(begins)
        start += [at + b for b in begins]
        at += len(body)
    return a.joiner.join(texts), field, np.array([*start, at], np.int64)


def attribute(rule: str, start: np.ndarray, end: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Tokens of each section, from the tokens' byte spans and the sections'
    bounds: an interval join of two sorted lists."""
    n = len(bounds) - 1
    if not len(start):
        return np.zeros(n)
    # of sections that begin together only the last has bytes
    a = np.searchsorted(bounds, start, side="right") - 1
    b = np.searchsorted(bounds, end - 1, side="right") - 1
    if rule == "first":
        return np.bincount(a, minlength=n).astype(float)
    if rule == "last":
        return np.bincount(b, minlength=n).astype(float)
    out = np.bincount(a[a == b], minlength=n).astype(float)
    for i in np.flatnonzero(a != b):
        s = np.arange(a[i], b[i] + 1)
        part = np.minimum(end[i], bounds[s + 1]) - np.maximum(start[i], bounds[s])
        if rule == "most":
            out[s[np.argmax(part)]] += 1
        else:
            out[s] += part / (end[i] - start[i])
    return out


def _count(a: Attribution, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokenizer, sizes = encoding(a)
    for batch in batches:
        held: list[tuple] = []
        n = 0
        columns = [batch.column(i + 1) for i in range(len(a.fields))]
        for row in range(batch.num_rows):
            text, field, bounds = sections_of(a, [c[row].as_py() for c in columns])
            ids = np.array(tokenizer.encode_ordinary(text), np.int64)
            end = np.cumsum(sizes[ids])
            tokens = attribute(a.rule, end - sizes[ids], end, bounds)
            # characters that begin before each byte
            raw = np.frombuffer(text.encode(), np.uint8)
            chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[bounds]
            held.append((row, field, chars, tokens))
            n += len(field)
            if n >= 50_000 or row + 1 == batch.num_rows:
                count = [len(h[1]) for h in held]
                yield pa.record_batch(
                    [
                        batch.column(0).take(pa.array(np.repeat([h[0] for h in held], count))),
                        pa.array([a.fields[f] for h in held for f in h[1]], pa.string()),
                        pa.array(np.concatenate([np.arange(k) for k in count]), pa.int64()),
                        pa.array(np.concatenate([h[2][:-1] for h in held]), pa.int64()),
                        pa.array(np.concatenate([h[2][1:] for h in held]), pa.int64()),
                        pa.array(np.concatenate([h[3] for h in held]), pa.float64()),
                    ],
                    names=["doc_id", "field", "section", "char_start", "char_end", "n_tokens"],
                )
                held, n = [], 0


def token_counts(docs: DataFrame, how: Attribution = Attribution(), key_col: str = "doc_id") -> DataFrame:
    """Encode each whole document once and attribute its tokens to its fields or
    lines by their offsets.

    Returns doc_id, field, section (number in the document), char_start and
    char_end (code points of the joined text), n_tokens (a double; whole under
    every rule but `split`). The sections of a document share out all its
    tokens: the sum of n_tokens is the number of tokens of the whole text.

    A null field is empty; an empty one still has a section, of no tokens. Every
    row is counted by itself, so ties, repeated rows and null ids make no
    difference; an empty table gives none; other columns are ignored.
    """
    if how.rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    cols = [F.col(key_col).cast("long").alias("doc_id"), *[F.col(f).alias(f"field_{i}") for i, f in enumerate(how.fields)]]
    return docs.select(*cols).mapInArrow(partial(_count, how), "doc_id long, field string, section long, char_start long, char_end long, n_tokens double")


def op4_token_attribution(spark, sf_dir):
    """Tokens of every line of every document."""
    out = token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "section", "char_start", "char_end", F.col("n_tokens").cast("long").alias("n_tokens"))
