"""Repeats of a fixed length across a corpus, exactly, without moving a row for
each position.

1. Every window of `length` symbols (bytes or words) has a content-defined
   anchor. Consecutive windows with one anchor form a segment, the text from the
   first window's start to the last one's end. Only anchors (about one for every
   35 bytes or 22 words) are dealt out, by the hash of the anchor: the prefix
   under which suffixes are grouped. A task first sorts the suffixes at the
   starts of segments that share an anchor, each to its segment's end: those
   that come out equal collapse to the first of them, before the shuffle.
2. Anchors that are left with one segment need no more. The segments of the
   others are cut from the texts and dealt out by anchor. There they are sorted
   once more as wholes, which collapses those of different tasks, and then the
   suffixes at all window starts of what is left are sorted to `length` symbols.
   Suffixes with equal windows are compared by their places.
3. Marked windows go back to their documents.

Hashes only say where a segment goes: that two of them, or two windows, are equal
is always the outcome of the sort (bytes) or a node of the tree (words).

Rows that pass between tasks are blobs of packed columns, one for each part.

An anchor seen in a hundredth of a sample of documents is hot: its segments are
dealt out by their own hash, and what is left of them window by window in a step
of its own, which is the same grouping under a longer prefix. The sample decides
the route alone.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import BLOB_SCHEMA, blob_batch, deal, frees, id_part, materialize, mix64, n_parts, pack, pieces, range_part, read_blobs, split_by_part, unpack_all
from ._symbols import anchors, byte_getter, word_hashes, word_spans

SAMPLE = 4096  # documents by which hot anchors are found
HOT = 0.01  # of those, to be hot
FLUSH = 8 << 20  # bytes of text that a task holds before it deals them out
GROUP = 32 << 20  # bytes of segments that a task sorts at once

#: Sorts the suffixes at the windows of segments: (segment offsets, bytes, start
#: of each window, window's segment) -> (windows in classes of equal content,
#: class of each).
Sorter = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
#: Sorts the suffixes at the starts of segments to the ends of those: (segment
#: offsets, bytes, group of each) -> classes of equal content, of one group each.
Whole = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Repeats:
    """unit: byte or word. between: only repeats from another, earlier document
    count; otherwise any earlier start does."""

    unit: str
    length: int
    k: int
    between: bool
    sorter: Sorter
    whole: Whole


# -- 1. anchors -----------------------------------------------------------------


def segments(job: Repeats, off: np.ndarray, buf: np.ndarray):
    """Row of the text, first window, windows, anchor hash, segment hash, first
    byte, end."""
    if job.unit == "byte":
        bounds, get = off, byte_getter(buf)
    else:
        ws, we, bounds = word_spans(off, buf)
        sym = word_hashes(buf, ws, we)
        get = lambda a, b: sym[a:b]
    s, n, h, g = anchors(get, bounds, job.length, job.k)
    row = np.searchsorted(bounds, s, side="right") - 1
    last = s + n - 2 + job.length
    first, end = (s, last + 1) if job.unit == "byte" else (ws[s], we[last])
    return row, s - bounds[row], n, h, g, first, end


def _collapse(job: Repeats, h, rid, place, cut) -> np.ndarray:
    """Which segments repeat an earlier one as a whole. cut(rows) gives offsets
    and bytes of some of them."""
    repeat = np.zeros(len(h), bool)
    if not len(h):
        return repeat
    order = np.lexsort((place, rid, place & 255, h))
    same = np.append(False, (h[order[1:]] == h[order[:-1]]) & ((place[order[1:]] & 255) == (place[order[:-1]] & 255)))
    group = np.cumsum(~same)
    shared = same.copy()
    shared[:-1] |= same[1:]
    rows, group = order[shared], group[shared]
    if len(rows):
        label = job.whole(*cut(rows), group)
        by = np.argsort(label, kind="stable")  # within a class by place
        rows, label = rows[by], label[by]
        first = rows[np.maximum.accumulate(np.where(np.append(True, label[1:] != label[:-1]), np.arange(len(label)), 0))]
        repeat[rows] = rid[rows] != rid[first] if job.between else rows != first
    return repeat


@frees
def _split_by_rid(kind: str, dtypes: tuple[str, ...], parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Deal rows out by row number. Done where a written table is read, in tasks
    as large as the files, so that few blobs go from each task to each part."""
    held: list[bytes] = []

    def flush():
        cols = unpack_all(held, dtypes)
        held.clear()
        return blob_batch([(kind, p, pack(*(c[r] for c in cols))) for p, r in split_by_part(id_part(cols[0], parts))])

    for batch in batches:
        held += batch.column(0).to_pylist()
        if sum(map(len, held)) >= 2 * FLUSH:
            yield flush()
    if held:
        yield flush()


def _by_rid(table: DataFrame, kind: str, dtypes: tuple[str, ...], parts: int) -> DataFrame:
    return table.where(F.col("kind") == kind).select("blob").mapInArrow(partial(_split_by_rid, kind, dtypes, parts), BLOB_SCHEMA)


def _delta(h: np.ndarray) -> np.ndarray:
    return np.diff(h, prepend=np.uint64(0))


@frees
def _map_anchors(job: Repeats, parts: int, hot: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []

    def flush():
        h, g, rid, place, first, end, buf = (np.concatenate(c) for c in zip(*held, strict=True))
        size = [len(x[6]) for x in held]
        move = np.repeat(np.cumsum(size) - size, [len(x[0]) for x in held])
        first, end = first + move, end + move
        held.clear()

        def cut(rows):
            n = end[rows] - first[rows]
            return np.concatenate([[0], np.cumsum(n)]), _gather(buf, first[rows], n)

        repeat = _collapse(job, h, rid, place, cut)
        out = [("mark", int(rid[0]) % parts, pack(rid[repeat], place[repeat]))] if len(rid) else []
        h, g, rid, place = h[~repeat], g[~repeat], rid[~repeat], place[~repeat]
        order = np.argsort(h, kind="stable")
        h, g, rid, place = h[order], g[order], rid[order], place[order]
        # an anchor is a minimum, so its own leading bits are all alike
        is_hot = np.isin(h, hot)
        route = mix64(np.where(is_hot, h ^ g, h))
        # the segment's hash is needed as a hot anchor's route alone
        out += [("anchor", p, pack(_delta(h[r]), np.where(is_hot[r], g[r], np.uint64(0)), rid[r], place[r])) for p, r in split_by_part(range_part(route, parts))]
        return blob_batch(out)

    for batch in batches:
        for rid, off, buf in pieces(batch, 0, 1):
            row, start, n, h, g, first, end = segments(job, off, buf)
            held.append((h, g, rid[row], start << 8 | n, first, end, buf))
            if sum(len(x[6]) for x in held) >= FLUSH:
                yield flush()
    if held:
        yield flush()


# -- 2. segments whose anchor others have --------------------------------------------


@frees
def _reduce_anchors(job: Repeats, hot: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks pass through; rows `want` ask a text for a segment."""
    got: dict[str, list[bytes]] = defaultdict(list)
    for batch in batches:
        read_blobs([batch], got)
        if got["mark"]:
            yield blob_batch([("mark", 0, b) for b in got.pop("mark")])
    if not got["anchor"]:
        return
    cols = [unpack_all([b], ("u8", "u8", "i8", "i8")) for b in got.pop("anchor")]
    h, g, rid, place = (np.concatenate(c) for c in zip(*((np.cumsum(x[0], dtype=np.uint64), *x[1:]) for x in cols), strict=True))
    del cols
    order = np.argsort(h, kind="stable")
    h, g, rid, place = h[order], g[order], rid[order], place[order]
    start = np.ones(len(h), bool)
    start[1:] = h[1:] != h[:-1]
    rows = np.diff(np.append(np.flatnonzero(start), len(h)))[np.cumsum(start) - 1]
    want = (rows > 1) | np.isin(h, hot)
    yield blob_batch([("want", 0, pack(rid[want], place[want], h[want], g[want]))])


# -- texts by document partition ----------------------------------------------------


@frees
def _pack_texts(parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind `text`: row numbers and texts of those that go to one partition."""
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for rid, off, buf in pieces(batch, 0, 1, 8 << 20):
            out = []
            raw = buf.tobytes()
            for p, rows in split_by_part(id_part(rid, parts)):
                body = b"".join([raw[off[i] : off[i + 1]] for i in rows])
                head = struct.pack("<q", len(rows)) + rid[rows].tobytes() + (off[rows + 1] - off[rows]).tobytes()
                out.append(("text", p, squeeze.compress(head + body)))
            yield blob_batch(out)


def _open_texts(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = struct.unpack_from("<q", raw)[0]
    rid = np.frombuffer(raw, np.int64, n, 8)
    size = np.frombuffer(raw, np.int64, n, 8 + 8 * n)
    return rid, np.concatenate([[0], np.cumsum(size)]), np.frombuffer(raw, np.uint8, offset=8 + 16 * n)


def texts_by_part(rows: DataFrame, parts: int) -> DataFrame:
    return rows.select("rid", "text").mapInArrow(partial(_pack_texts, parts), BLOB_SCHEMA)


def _gather(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices of buf one after another."""
    at = np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)
    return buf[at]


# -- 3. suffixes --------------------------------------------------------------------


def _segment_blob(rid, place, h, buf, start, size) -> bytes:
    raw = struct.pack("<q", len(rid)) + rid.tobytes() + place.tobytes() + h.tobytes() + size.tobytes() + _gather(buf, start, size).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


@frees
def _cut_segments(job: Repeats, parts: int, hot: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = read_blobs(batches, defaultdict(list))
    want = unpack_all(got.pop("want", []), ("i8", "i8", "u8", "u8"))
    order = np.argsort(want[0], kind="stable")
    want = [c[order] for c in want]
    held: list[tuple[np.ndarray, ...]] = []

    def flush():
        """One blob for each part, of all texts seen so far."""
        rid, place, h, route, size, body = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        at = np.cumsum(size) - size
        return blob_batch([("segment", p, _segment_blob(rid[r], place[r], h[r], body, at[r], size[r])) for p, r in split_by_part(range_part(route, parts))])

    for blob in got["text"]:
        ids, off, buf = _open_texts(blob)
        a, b = np.searchsorted(want[0], ids), np.searchsorted(want[0], ids, side="right")
        if not (b > a).any():
            continue
        row = np.repeat(np.arange(len(ids)), b - a)
        at = np.arange(len(row)) + np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a)
        rid, place, h, g = (c[at] for c in want)
        start, last = place >> 8, (place >> 8) + (place & 255) - 2 + job.length
        if job.unit == "byte":
            first, end = off[row] + start, off[row] + last + 1
        else:
            ws, we, bounds = word_spans(off, buf)
            first, end = ws[bounds[row] + start], we[bounds[row] + last]
        route = mix64(np.where(np.isin(h, hot), h ^ g, h))
        held.append((rid, place, h, route, end - first, _gather(buf, first, end - first)))
        if sum(len(x[5]) for x in held) >= 2 * FLUSH:
            yield flush()
    if held:
        yield flush()


def hash_bytes(b: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(b)


def _open_segments(blobs: list[bytes], group: int = 0, groups: int = 1):
    """rid, place, anchor, offsets, bytes of the segments in one of the groups
    into which their anchors' hashes divide them."""
    cols: list[list[np.ndarray]] = [[], [], [], []]
    body = []
    for blob in blobs:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n = struct.unpack_from("<q", raw)[0]
        own = [np.frombuffer(raw, t, n, 8 + 8 * n * k) for k, t in enumerate(("i8", "i8", "u8", "i8"))]
        text = np.frombuffer(raw, np.uint8, offset=8 + 32 * n)
        if groups > 1:
            keep = np.flatnonzero(range_part(mix64(own[2] ^ np.uint64(groups)), groups) == group)
            size = own[3]
            text = _gather(text, (np.cumsum(size) - size)[keep], size[keep])
            own = [c[keep] for c in own]
        for to, c in zip(cols, own, strict=True):
            to.append(c)
        body.append(text)
    rid, place, h, size = (np.concatenate(c) for c in cols)
    return rid, place, h, np.concatenate([[0], np.cumsum(size)]), np.concatenate(body)


def _grouped(batches: Iterator[pa.RecordBatch], kind: str):
    """The segments of a partition, in groups that fit in memory: an anchor's
    stay together."""
    blobs = read_blobs(batches, defaultdict(list))[kind]
    total = sum(max(0, zstandard.frame_content_size(b)) for b in blobs)
    groups = -(-total // GROUP)
    for group in range(groups):
        own = _open_segments(blobs, group, groups)
        if len(own[0]):
            yield own


def mark_windows(job: Repeats, rid, place, off, buf) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the segments that occur earlier, as (rid, place) runs."""
    start, n = place >> 8, place & 255
    seg = np.repeat(np.arange(len(rid)), n)
    step = np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n)
    windows, label = job.sorter(off, buf, step, seg)
    if not len(windows):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    doc, at = rid[seg[windows]], (start[seg] + step)[windows]
    order = np.lexsort((at, doc, label))
    doc, at, label, windows = doc[order], at[order], label[order], windows[order]
    first = np.maximum.accumulate(np.where(np.append(True, label[1:] != label[:-1]), np.arange(len(label)), 0))
    late = doc != doc[first] if job.between else (doc != doc[first]) | (at != at[first])
    marked = np.zeros(len(seg), bool)
    marked[windows[late]] = True
    new = marked.copy()
    new[1:] &= ~marked[:-1] | (seg[1:] != seg[:-1])
    end = marked.copy()
    end[:-1] &= ~marked[1:] | (seg[1:] != seg[:-1])
    a, b = np.flatnonzero(new), np.flatnonzero(end)
    return rid[seg[a]], (start[seg[a]] + step[a]) << 8 | (b - a + 1)


def _select(rows: np.ndarray, off: np.ndarray, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = off[rows + 1] - off[rows]
    return np.concatenate([[0], np.cumsum(size)]), _gather(buf, off[rows], size)


def _cut_windows(job: Repeats, parts: int, rid, place, h, off, buf) -> list[tuple[str, int, bytes]]:
    """Each window of some segments for itself, dealt out by its own hash."""
    n = place & 255
    seg = np.repeat(np.arange(len(rid)), n)
    step = np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n)
    if job.unit == "byte":
        first = off[seg] + step
        end = first + job.length
    else:
        ws, we, bounds = word_spans(off, buf)
        first, end = ws[bounds[seg] + step], we[bounds[seg] + step - 1 + job.length]
    raw = buf.tobytes()
    whole = (lambda b: b) if job.unit == "byte" else (lambda b: b" ".join(b.split()))
    key = np.array([hash_bytes(whole(raw[i:j])) for i, j in zip(first.tolist(), end.tolist(), strict=True)], np.uint64)
    place = (place[seg] >> 8) + step << 8 | 1
    return [("window", p, _segment_blob(rid[seg[r]], place[r], key[r], buf, first[r], (end - first)[r])) for p, r in split_by_part(range_part(mix64(key), parts))]


@frees
def _sort_segments(job: Repeats, parts: int, hot: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kinds: mark, and window for what is left of hot anchors."""
    for rid, place, h, off, buf in _grouped(batches, "segment"):
        repeat = _collapse(job, h, rid, place, lambda rows: _select(rows, off, buf))  # noqa: B023
        yield blob_batch([("mark", 0, pack(rid[repeat], place[repeat]))])
        is_hot = np.isin(h, hot)
        rows = np.flatnonzero(~repeat & is_hot)
        for a in range(0, len(rows), 1 << 14):
            own = rows[a : a + (1 << 14)]
            yield blob_batch(_cut_windows(job, parts, rid[own], place[own], h[own], *_select(own, off, buf)))
        _, number, seen = np.unique(h[~repeat], return_inverse=True, return_counts=True)
        rows = np.flatnonzero(~repeat)[(seen[number] > 1)]
        rows = rows[~is_hot[rows]]
        if len(rows):
            yield blob_batch([("mark", 0, pack(*mark_windows(job, rid[rows], place[rows], *_select(rows, off, buf))))])


@frees
def _sort_windows(job: Repeats, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rid, place, _, off, buf in _grouped(batches, "window"):
        yield blob_batch([("mark", 0, pack(*mark_windows(job, rid, place, off, buf)))])


# -- 4. documents -------------------------------------------------------------------

RESULT_SCHEMA = "rid long, n long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"


@frees
def _apply_marks(job: Repeats, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = read_blobs(batches, defaultdict(list))
    rid, place = unpack_all(got["mark"], ("i8", "i8"))
    order = np.argsort(rid, kind="stable")
    rid, place = rid[order], place[order]
    while got["text"]:
        ids, off, buf = _open_texts(got["text"].pop())
        if job.unit == "byte":
            bounds = off
        else:
            ws, we, bounds = word_spans(off, buf)
        a, b = np.searchsorted(rid, ids), np.searchsorted(rid, ids, side="right")
        row = np.repeat(np.arange(len(ids)), b - a)
        own = place[np.arange(len(row)) + np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a)]
        first = bounds[row] + (own >> 8)
        total = int(bounds[-1])
        step = np.zeros(total + 1, np.int32)
        np.add.at(step, first, 1)
        np.add.at(step, first + (own & 255) - 1 + job.length, -1)
        gone = np.cumsum(step)[:total] > 0
        edge = np.zeros(total + 1, bool)
        edge[bounds] = True
        new, end = gone.copy(), gone.copy()
        if total:
            new[1:] &= ~gone[:-1] | edge[1:total]
            end[:-1] &= ~gone[1:] | edge[1:total]
        lo, hi = np.flatnonzero(new), np.flatnonzero(end) + 1
        which = np.searchsorted(bounds, lo, side="right") - 1
        removed = np.concatenate([[0], np.cumsum(gone)])
        keep = ~gone
        if job.unit == "byte":
            body, size = buf[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]
        else:
            # kept words, each with a space after it, but for a document's last
            s, n = ws[keep], (we - ws)[keep] + 1
            body = _gather(np.append(buf, np.uint8(0x20)), s, n)
            ends = np.cumsum(n)
            body[ends - 1] = 0x20
            words = np.concatenate([[0], np.cumsum(keep)])[bounds]
            upto = np.concatenate([[0], ends])[words]
            drop = np.diff(words) > 0
            body = np.delete(body, upto[1:][drop] - 1)
            size = upto - np.concatenate([[0], np.cumsum(drop)])
        spans = pa.StructArray.from_arrays([pa.array(lo - bounds[which]), pa.array(hi - bounds[which])], names=["start", "end"])
        yield pa.record_batch(
            [
                pa.array(ids),
                pa.array(np.diff(bounds)),
                pa.array(removed[bounds[1:]] - removed[bounds[:-1]]),
                pa.ListArray.from_arrays(pa.array(np.searchsorted(which, np.arange(len(ids) + 1)).astype(np.int32)), spans),
                pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(size.astype(np.int32).tobytes()), pa.py_buffer(body.tobytes())]),
            ],
            names=["rid", "n", "n_removed", "spans", "kept"],
        )


# -- all ------------------------------------------------------------------------------


@frees
def _count_anchors(job: Repeats, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, off, buf in pieces(batch, 0, 1):
            row, _, _, h, *_ = segments(job, off, buf)
            if len(h):
                seen = np.unique(np.stack([h, row.astype(np.uint64)]), axis=1)[0]
                yield pa.record_batch([pa.array(seen.view(np.int64))], names=["h"])


def hot_anchors(job: Repeats, rows: DataFrame) -> np.ndarray:
    """Anchors in a hundredth of at most about SAMPLE documents; there are no
    more of them than a hundred documents have anchors."""
    every = max(1, rows.count() // SAMPLE)
    some = rows.where(F.pmod(F.xxhash64("rid"), F.lit(every)) == 0).select("rid", "text")
    least = max(16, int(SAMPLE * HOT))
    found = some.mapInArrow(partial(_count_anchors, job), "h long").groupBy("h").count().where(F.col("count") >= least).select("h").collect()
    return np.array([r.h for r in found], np.int64).view(np.uint64)


def remove_repeats(rows: DataFrame, job: Repeats) -> DataFrame:
    """rows: (rid, text), rid unique. Returns RESULT_SCHEMA, a row per row."""
    parts = n_parts(rows)
    hot = hot_anchors(job, rows)
    dealt = deal(rows.select("rid", "text").mapInArrow(partial(_map_anchors, job, parts, hot), BLOB_SCHEMA), parts)
    first = materialize(dealt.mapInArrow(partial(_reduce_anchors, job, hot), BLOB_SCHEMA), "segments")
    want = _by_rid(first, "want", ("i8", "i8", "u8", "u8"), parts)
    cut = deal(texts_by_part(rows, parts).unionAll(want), parts).mapInArrow(partial(_cut_segments, job, parts, hot), BLOB_SCHEMA)
    second = materialize(deal(cut, parts).mapInArrow(partial(_sort_segments, job, parts, hot), BLOB_SCHEMA), "windows")
    all_marks = first.unionAll(second)
    if len(hot):
        windows = deal(second.where("kind = 'window'"), parts)
        all_marks = all_marks.unionAll(materialize(windows.mapInArrow(partial(_sort_windows, job), BLOB_SCHEMA), "hot-windows"))
    marks = _by_rid(all_marks, "mark", ("i8", "i8"), parts)
    return deal(texts_by_part(rows, parts).unionAll(marks), parts).mapInArrow(partial(_apply_marks, job), RESULT_SCHEMA)
