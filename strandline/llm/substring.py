"""Exact substring dedup over bytes (suffix arrays) and words (suffix trees)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import deepshallow, suffixtree
from ._common import give_back_key, keyed_rows
from ._repeats import Repeats, remove_repeats
from ._symbols import word_numbers, word_spans


def _sort_bytes(length: int):
    def sorter(off, buf, step, seg):
        order, same = deepshallow.suffix_order(buf, off[seg] + step, length)
        label = np.cumsum(~same)
        part = same.copy()
        part[:-1] |= same[1:]
        return order[part], label[part]

    return sorter


def _whole_bytes(off, buf, group):
    order, same = deepshallow.suffix_order(buf, off[:-1], np.diff(off), group=group)
    label = np.empty(len(order), np.int64)
    label[order] = np.cumsum(~same)
    return label


def _sort_words(length: int):
    def sorter(off, buf, step, seg):
        ws, we, bounds = word_spans(off, buf)
        return suffixtree.repeats(word_numbers(buf, ws, we), bounds[seg] + step, length)

    return sorter


def _whole_words(off, buf, group):
    ws, we, bounds = word_spans(off, buf)
    leaves, nodes = suffixtree.deep_nodes(word_numbers(buf, ws, we), bounds[:-1], np.diff(bounds), group)
    label = np.arange(len(group))
    label[leaves] = len(group) + np.repeat(np.arange(len(nodes)), np.diff(np.append(nodes, len(leaves))))
    return label


def suffix_array_dedup(docs: DataFrame, length: int = 100) -> DataFrame:
    """Remove every byte covered by a `length`-byte string that also starts
    earlier: in a document with a smaller doc_id, or before in the same one.

    Which strings are equal is decided by deep-shallow sorting alone, a multikey
    quicksort to a shallow depth and blind tries beyond: first of the suffixes at
    the starts of segments (stretches between content-defined cuts), then at all
    positions of the segments left over. Hashes of the anchors at the cuts only
    say which suffixes meet. Strings are judged on the input, not on what is
    left; they never cross documents.

    Returns doc_id, n_bytes, n_removed, spans (maximal removed runs, byte
    offsets), kept (binary: a cut may split a character).

    A null text is empty; an empty table gives none; other columns are ignored,
    whatever their names. Where doc_id repeats or is null, every row is a
    document of its own and "smaller" means earlier in the order (doc_id, nulls
    first; text). Texts are read whole, whatever their length.
    """
    if not 32 <= length:
        raise ValueError("length must be 32 or more")
    rows, same = keyed_rows(docs)
    job = Repeats("byte", length, max(length * 32 // 100, length - 250), False, _sort_bytes(length), _whole_bytes)
    out = remove_repeats(rows, job).select("rid", F.col("n").alias("n_bytes"), "n_removed", "spans", "kept")
    return give_back_key(out, rows, same)


def suffix_tree_dedup(docs: DataFrame, length: int = 50) -> DataFrame:
    """Remove every word covered by a window of `length` words that also starts
    in a document with a smaller doc_id; repeats within one document stay.

    Suffixes are grouped under the words of an anchor that their windows hold, and
    in each task under prefixes of variable length, into groups that fit in
    memory; each group's tree is written top-down, and its internal nodes `length`
    words deep (or as deep as a whole segment) are the repeats. Words are told
    apart by their bytes.

    Returns doc_id, n_words, n_removed, spans (maximal removed runs, word
    numbers), kept (kept words joined by one space, UTF-8 bytes). Nulls, ties,
    repeated rows, empty tables, other columns: as in suffix_array_dedup.
    """
    if not 8 <= length <= 250:
        raise ValueError("length must be 8 to 250")
    rows, same = keyed_rows(docs)
    job = Repeats("word", length, max(2, length * 8 // 50), True, _sort_words(length), _whole_words)
    out = remove_repeats(rows, job).select("rid", F.col("n").alias("n_words"), "n_removed", "spans", "kept")
    return give_back_key(out, rows, same)


def op1_suffix_array_dedup(spark, sf_dir):
    """Digest columns of suffix_array_dedup over all documents."""
    out = suffix_array_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), 100)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_suffix_tree_dedup(spark, sf_dir):
    """Digest columns of suffix_tree_dedup over all documents."""
    out = suffix_tree_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), 50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
