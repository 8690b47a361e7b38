"""Near-duplicate documents by an LSH forest over MinHash signatures.

The signature's values are read in several orders, one for each tree. Documents
that agree in the first values of an order stand next to each other when sorted
by it; neighbours with the longest common prefix are candidates, as is the
first document of a region. Where a region is large, its depth grows until it
is not. Candidates are confirmed on full shingle sets, and documents linked
directly or through others form one component.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import BLOB_SCHEMA, blob_batch, deal, frees, id_part, keyed_rows, materialize, mix64, n_parts, pack, pieces, range_part, read_blobs, split_by_part, unpack_all
from ._repeats import _open_texts, texts_by_part
from ._symbols import prefix, window_hashes, word_hashes, word_spans
from .graph import components, gathered

TREE = 8  # values in a tree's order that are sent along
SAMPLE = 4096  # documents by which crowded prefixes are found
CROWDED = 0.01


@dataclass(frozen=True)
class Forest:
    """percent: least similarity. depth: values that candidates share at least.
    With 16 trees a pair at 85 percent is missed by all of them with a chance of
    8 in a million at depth 4, one at 80 percent with 1 in 100,000 at depth 3.
    region: rows above which a region's depth grows. room: shingles of candidates
    that hang together which are confirmed in one chunk; more are dealt out over
    chunks. most: shingles in a block of those that are still apart then."""

    words: int = 5
    percent: int = 85
    trees: int = 16
    depth: int = 4
    region: int = 64
    room: int = 1 << 15
    most: int = 1 << 21


def shingle_sets(words: int, off: np.ndarray, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and their offsets."""
    ws, we, first = word_spans(off, buf)
    sym = word_hashes(buf, ws, we, lower=True)
    all_windows = window_hashes(sym, words)
    n = np.diff(first)
    out = []
    for a, k in zip(first[:-1].tolist(), n.tolist(), strict=True):
        if k >= words:
            s = np.sort(all_windows[a : a + k - words + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif k:
            p, _ = prefix(sym[a : a + k])
            out.append(mix64(p[-1:] + np.uint64(k)))
        else:
            out.append(np.empty(0, np.uint64))
    size = np.array([len(s) for s in out], np.int64)
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), np.concatenate([[0], np.cumsum(size)])


def _coefficients(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20231)
    return rng.integers(0, 1 << 63, k, dtype=np.uint64) << np.uint64(1) | np.uint64(1), rng.integers(0, 1 << 63, k, dtype=np.uint64)


def signatures(sets: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """k minima (uint32) of each set; no set is empty."""
    out = np.empty((len(at) - 1, k), np.uint32)
    a, b = _coefficients(k)
    for i in range(k):
        out[:, i] = np.minimum.reduceat((sets * a[i] + b[i]) >> np.uint64(32), at[:-1])
    return out


def _prefix_keys(sig: np.ndarray, tree: int, depths: list[int]) -> list[np.ndarray]:
    """Hashes of the first values of a tree's order, at each depth."""
    k = sig.shape[1]
    order = (tree * TREE + np.arange(max(depths))) % k
    out, h, d = [], np.full(len(sig), tree + 1, np.uint64), 0
    for depth in depths:
        while d < depth:
            h = mix64(h ^ (sig[:, order[d]].astype(np.uint64) + np.uint64((d + 1) * 0x9E3779B97F4A7C15 % (1 << 64))))
            d += 1
        out.append(h)
    return out


def _own_prefix(f: Forest, tree: np.ndarray, cols: list[np.ndarray]) -> np.ndarray:
    """_prefix_keys at `depth`, from the columns that are sent along."""
    h = (tree + 1).astype(np.uint64)
    for d in range(f.depth):
        v = cols[d // 2] & np.uint64(0xFFFFFFFF) if d % 2 else cols[d // 2] >> np.uint64(32)
        h = mix64(h ^ (v + np.uint64((d + 1) * 0x9E3779B97F4A7C15 % (1 << 64))))
    return h


def _depths(f: Forest) -> list[int]:
    return [f.depth, 8, 16, 32]


def _signed_sets(f: Forest, batches: Iterator[pa.RecordBatch]):
    """(rid, set size) of all rows, then of those that have words: rid, size,
    two sums that tell sets apart, signature."""
    for batch in batches:
        for rid, off, buf in pieces(batch, 0, 1, 1 << 20):
            sets, at = shingle_sets(f.words, off, buf)
            n = np.diff(at)
            full = n > 0
            if not full.any():
                yield rid, n, rid[:0], n[:0], sets, sets, np.empty((0, f.trees * TREE), np.uint32)
                continue
            start = at[:-1][full]
            sums = [np.add.reduceat(mix64(sets ^ np.uint64(c)), start) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
            yield rid, n, rid[full], n[full], *sums, signatures(sets, np.append(start, len(sets)), f.trees * TREE)


@frees
def _map_signatures(f: Forest, parts: int, crowded: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def flush():
        all_rid, all_n, rid, n, one, two, sig = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        out = [("count", p, pack(all_rid[r], all_n[r])) for p, r in split_by_part(id_part(all_rid, parts))]
        order = np.lexsort((rid, two, one))
        rid, one, two, sig = rid[order], one[order], two[order], sig[order]
        new = np.ones(len(rid), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        first = rid[np.maximum.accumulate(np.where(new, np.arange(len(rid)), 0))]
        out += [("copy", p, pack(rid[~new][r], first[~new][r])) for p, r in split_by_part(id_part(first[~new], parts))]
        rid, one, sig = rid[new], one[new], sig[new]
        rows, routes = [], []
        for t in range(f.trees):
            keys = _prefix_keys(sig, t, _depths(f))
            route = keys[0]
            for deeper, h in zip(keys[1:], keys[:-1], strict=True):
                # crowded at every depth so far: the next one deals the row out
                route = np.where((route == h) & np.isin(h, crowded), deeper, route)
            own = sig[:, t * TREE : (t + 1) * TREE].astype(np.uint64)
            rows.append([np.full(len(rid), t, np.int64), rid, one, *(own[:, j] << np.uint64(32) | own[:, j + 1] for j in range(0, TREE, 2))])
            routes.append(route)
        cols, route = [np.concatenate(c) for c in zip(*rows, strict=True)], np.concatenate(routes)
        out += [("tree", p, pack(*(c[r] for c in cols))) for p, r in split_by_part(range_part(route, parts))]
        return blob_batch(out)

    for x in _signed_sets(f, batches):
        held.append(x)
        if sum(len(h[0]) for h in held) >= 8192:
            yield flush()
    if held:
        yield flush()


@frees
def _count_prefixes(f: Forest, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, _, _, _, _, _, sig in _signed_sets(f, batches):
        for t in range(f.trees):
            for h in _prefix_keys(sig, t, _depths(f)[:-1]):
                yield pa.record_batch([pa.array(h.view(np.int64))], names=["h"])


def crowded_prefixes(f: Forest, rows: DataFrame) -> np.ndarray:
    """Prefixes of a hundredth of at most about SAMPLE documents, at most a hundred
    for each tree and depth. They decide routes alone: rows of one crowded prefix
    are dealt out by more values, and `met` makes those of all tasks hang together
    again, so that all of them are compared."""
    every = max(1, rows.count() // SAMPLE)
    some = rows.where(F.pmod(F.xxhash64("rid"), F.lit(every)) == 0).select("rid", "text")
    found = some.mapInArrow(partial(_count_prefixes, f), "h long").groupBy("h").count().where(F.col("count") >= max(16, int(SAMPLE * CROWDED))).select("h").collect()
    return np.array([r.h for r in found], np.int64).view(np.uint64)


_TREE_TYPES = ("i8", "i8", "u8", "u8", "u8", "u8", "u8")


def candidate_pairs(f: Forest, tree, rid, one, cols) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours in a sorted order with `depth` equal leading values, and each
    row with its region's first."""
    v = np.stack([x for c in cols for x in (c >> np.uint64(32), c & np.uint64(0xFFFFFFFF))], axis=1)
    equal = np.ones(len(rid), bool)
    equal[:1] = False
    equal[1:] = tree[1:] == tree[:-1]
    lcp = np.zeros(len(rid), np.int64)
    for j in range(TREE):
        equal[1:] &= v[1:, j] == v[:-1, j]
        lcp += equal
    n = len(rid)
    near = lcp >= f.depth
    pairs = [np.flatnonzero(near)]
    to = [pairs[0] - 1]
    two = np.flatnonzero(near[1:] & near[:-1]) + 1
    pairs.append(two)
    to.append(two - 2)
    todo = np.ones(n, bool)
    for d in range(f.depth, TREE + 1):
        start = np.flatnonzero(lcp < d)
        size = np.diff(np.append(start, n))
        region = np.cumsum(lcp < d) - 1
        fit = todo & ((size[region] <= f.region) | (d == TREE))
        own = np.flatnonzero(fit & (start[region] != np.arange(n)))
        pairs.append(own)
        to.append(start[region[own]])
        todo &= ~fit
    a, b = rid[np.concatenate(pairs)], rid[np.concatenate(to)]
    a, b = np.maximum(a, b), np.minimum(a, b)
    both = np.unique(np.stack([a[a != b], b[a != b]]), axis=1)
    return both[0], both[1]


@frees
def _regions(f: Forest, crowded: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kinds: count and copy pass; pair (larger, smaller rid); near (row, first
    row that this task's pairs lead it to), by which candidates hang together;
    met (crowded prefix, its first row here), as other tasks hold more of it."""
    got: dict[str, list[bytes]] = defaultdict(list)
    for batch in batches:
        read_blobs([batch], got)
        passed = [(k, 0, x) for k in ("count", "copy") for x in got.pop(k, ())]
        if passed:
            yield blob_batch(passed)
    if not got["tree"]:
        return
    tree, rid, one, *cols = unpack_all(got.pop("tree"), _TREE_TYPES)
    order = np.lexsort((rid, one, *cols[::-1], tree))
    tree, rid, one, cols = tree[order], rid[order], one[order], [c[order] for c in cols]
    new = np.ones(len(rid), bool)
    new[1:] = (tree[1:] != tree[:-1]) | (one[1:] != one[:-1])
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    first = rid[np.maximum.accumulate(np.where(new, np.arange(len(rid)), 0))]
    copy = ~new & (tree == 0)
    tree, own, one, cols = tree[new], rid[new], one[new], [c[new] for c in cols]
    a, b = candidate_pairs(f, tree, own, one, cols)
    prefixes = _own_prefix(f, tree, cols)
    many = np.flatnonzero(np.isin(prefixes, crowded))
    shared, at = np.unique(prefixes[many], return_index=True)
    yield blob_batch([("met", 0, pack(shared.view(np.int64), own[many[at]])), ("copy", 0, pack(rid[copy], first[copy])), ("pair", 0, pack(a, b)), ("near", 0, pack(*gathered(a, b)))])


def _rows_of(kind: str, table: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Two columns of longs from the blobs of one kind."""

    def open_blobs(batches):
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                cols = unpack_all([blob], ("i8", "i8"))
                if len(cols[0]):
                    yield pa.record_batch([pa.array(c) for c in cols], names=list(names))

    return table.where(F.col("kind") == kind).select("blob").mapInArrow(open_blobs, ", ".join(f"{n} long" for n in names))


def met(table: DataFrame) -> DataFrame:
    """Links (a, b) between the tasks that hold rows of one crowded prefix. Inside
    a task neighbours link them all, so that one row of each task is enough."""
    rows = _rows_of("met", table, ("h", "a"))
    least = rows.groupBy("h").agg(F.min("a").alias("b"))
    return rows.join(least, "h").where("a <> b").select("a", "b")


# -- confirming ---------------------------------------------------------------------


@frees
def _pack_columns(kind: str, parts: int, by: int, part_of, batches):
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(batch.num_columns)]
        if len(cols[0]):
            yield blob_batch([(kind, p, pack(*(c[r] for c in cols))) for p, r in split_by_part(part_of(cols[by], parts))])


@frees
def _send_sets(f: Forest, parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingle sets of wanted documents, to the tasks of their chunks."""
    got = read_blobs(batches, defaultdict(list))
    rid, chunk = unpack_all(got["want"], ("i8", "i8"))
    order = np.argsort(rid, kind="stable")
    rid, chunk = rid[order], chunk[order]
    for blob in got["text"]:
        ids, off, buf = _open_texts(blob)
        a, b = np.searchsorted(rid, ids), np.searchsorted(rid, ids, side="right")
        rows = np.flatnonzero(b > a)
        if not len(rows):
            continue
        raw = [buf[off[i] : off[i + 1]] for i in rows]
        sets, at = shingle_sets(f.words, np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64), np.concatenate(raw))
        to = [(int(c), j) for j, i in enumerate(rows) for c in chunk[a[i] : b[i]]]
        where = id_part(np.array([c for c, _ in to]), parts)
        out = []
        for p, r in split_by_part(where):
            head = np.array([[to[x][0], ids[rows[to[x][1]]], at[to[x][1] + 1] - at[to[x][1]]] for x in r], np.int64)
            out.append(("set", p, struct.pack("<q", len(r)) + head.tobytes() + b"".join(sets[at[to[x][1]] : at[to[x][1] + 1]].tobytes() for x in r)))
        yield blob_batch(out)


@frees
def _confirm(f: Forest, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (rid, smallest rid it is linked with in its chunk). Pairs already
    in one component are passed over. Where a pair's last column is 1, the link
    is known, its ends may lie elsewhere, and only what is new is returned."""
    got = read_blobs(batches, defaultdict(list))
    sets: dict[tuple[int, int], np.ndarray] = {}
    for blob in got.pop("set", []):
        n = struct.unpack_from("<q", blob)[0]
        head = np.frombuffer(blob, np.int64, 3 * n, 8).reshape(n, 3)
        at = 8 + 24 * n
        for c, r, k in head.tolist():
            sets[c, r] = np.frombuffer(blob, np.uint64, k, at)
            at += 8 * k
    a, b, chunk, known = unpack_all(got["pair"], ("i8", "i8", "i8", "i8")) if got["pair"] else [np.empty(0, np.int64)] * 4
    order = np.lexsort((a, b, chunk))
    up: dict[tuple[int, int], tuple[int, int]] = {}

    def root(x):
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    for i in order.tolist():
        c = int(chunk[i])
        x, y = (c, int(a[i])), (c, int(b[i]))
        if known[i]:
            p, q = sorted((root(x), root(y)))
            if p != q:
                up[q] = p
            continue
        if x not in sets or y not in sets:
            raise ValueError("a candidate's shingle set did not arrive")
        p, q = root(x), root(y)
        if p != q and similar(sets[x], sets[y], f.percent):
            p, q = min(p, q), max(p, q)
            up[q] = p
    before = {x: root(x) for x in list(up)} if known.any() else {}
    by_chunk: dict[int, list[int]] = defaultdict(list)
    for c, r in sets:
        by_chunk[c].append(r)
    for c, members in by_chunk.items():
        _complete(f, c, sorted(members), sets, up, root)
    ids = {(before.get(x, x)[1], root(x)[1]) for x in list(up)}
    ids = sorted(x for x in ids if x[0] != x[1])
    if ids:
        cols = np.array(ids, np.int64)
        yield pa.record_batch([pa.array(cols[:, 0]), pa.array(cols[:, 1])], names=["a", "b"])


def _complete(f: Forest, chunk: int, members: list[int], sets, up, root) -> None:
    """Find the links that neighbours in the forest's orders have missed: all
    pairs of a chunk that are similar share a hash in their prefixes (of a set's
    hashes, rarest in the chunk first, so many that the rest alone can't reach
    the similarity). Only pairs in different components are looked at, so where
    candidates have all come together already, nothing is."""
    groups: dict[int, list[int]] = defaultdict(list)
    for r in members:
        groups[root((chunk, r))[1]].append(r)
    if len(groups) < 2:
        return
    largest = max(groups, key=lambda g: (len(groups[g]), -g))
    at = np.array([r for r in members if len(sets[chunk, r])], np.int64)
    if not len(at):
        return
    known, seen = np.unique(np.concatenate([sets[chunk, r] for r in at.tolist()]), return_counts=True)
    heads, size = [], np.array([len(sets[chunk, r]) for r in at.tolist()])
    for r, n in zip(at.tolist(), size.tolist(), strict=True):
        s = sets[chunk, r]
        rarest = np.lexsort((s, seen[np.searchsorted(known, s)]))
        heads.append(s[rarest[: n - -(-n * f.percent // 100) + 1]])
    owner = np.repeat(np.arange(len(at)), [len(h) for h in heads])
    tokens = np.concatenate(heads)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    for i, r in enumerate(at.tolist()):
        x = (chunk, r)
        if root(x)[1] == largest:
            continue
        lo, hi = np.searchsorted(tokens, heads[i]), np.searchsorted(tokens, heads[i], side="right")
        near = np.unique(np.concatenate([owner[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]))
        near = near[(100 * np.minimum(size[near], size[i]) >= f.percent * np.maximum(size[near], size[i])) & (near != i)]
        for j in near.tolist():
            y = (chunk, int(at[j]))
            p, q = root(x), root(y)
            if p != q and similar(sets[x], sets[y], f.percent):
                p, q = min(p, q), max(p, q)
                up[q] = p
                largest = p[1] if q[1] == largest else largest


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on sorted distinct hashes."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def confirmed_links(f: Forest, rows: DataFrame, want: DataFrame, pairs: DataFrame, known: bool = False) -> DataFrame:
    """want (rid, chunk): who goes to which chunk. pairs (a, b, chunk). known:
    the pairs are links already, and only new ones are looked for."""
    parts = n_parts(rows)
    asked = want.select("rid", "chunk").mapInArrow(partial(_pack_columns, "want", parts, 0, id_part), BLOB_SCHEMA)
    sets = deal(texts_by_part(rows, parts).unionAll(asked), parts).mapInArrow(partial(_send_sets, f, parts), BLOB_SCHEMA)
    packed = pairs.select("a", "b", "chunk", F.lit(int(known)).cast("long")).mapInArrow(partial(_pack_columns, "pair", parts, 2, id_part), BLOB_SCHEMA)
    return deal(sets.unionAll(packed), parts).mapInArrow(partial(_confirm, f), "a long, b long")


def _hint(large: DataFrame):
    """Broadcast a table with a row for each root of `large` where those are few.
    Otherwise its joins are left to the planner, which splits hot roots."""
    return F.broadcast if large.select("root").distinct().count() <= 20_000 else lambda df: df


def links_between(f: Forest, rows: DataFrame, large: DataFrame, links: DataFrame) -> DataFrame:
    """large (id, root, n): candidates that hang together (root) with more than
    `room` shingles. The links among them that (a, b) of links do not imply.
    Of two that are in different components, one at least is outside the
    largest; blocks of those meet every block of all, two blocks in one task. A
    block holds `room` shingles, or up to `most` where much is outside: then four
    blocks hold all that is, so that nothing is sent more than some eight times
    until even `most` is too little."""
    found = components(links).select(F.col("id").alias("of"), F.col("root").alias("found"))
    now = large.join(found, large.id == found.of, "left").select("id", "root", "n", F.coalesce("found", "id").alias("own"))
    now = materialize(now, "known")
    hint = _hint(now)
    most = now.groupBy("root", "own").agg(F.count("*").alias("size")).groupBy("root").agg(F.max(F.struct("size", "own")).alias("most"))
    most = most.select("root", F.col("most.own").alias("largest"))
    outside = F.col("own") != F.col("largest")
    per = now.join(hint(most), "root").groupBy("root", "largest").agg(F.sum("n").alias("all"), F.sum(F.when(outside, F.col("n"))).alias("late")).where("late > 0")
    block = F.least(F.lit(f.most), F.greatest(F.lit(max(1, f.room)), F.ceil(F.col("late") / 4)))
    blocks = lambda n: F.ceil(F.col(n) / block).cast("long")
    at = now.join(hint(materialize(per.select("root", "largest", blocks("all").alias("blocks"), blocks("late").alias("late")), "blocks")), "root")
    at = at.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn("part", F.when(outside, F.pmod(F.xxhash64("id", F.lit(1)), F.col("late"))))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    whole = at.select("id", "own", "root", "block", each("late").alias("part"))
    late = at.where("part is not null").select("id", "own", "root", each("blocks").alias("block"), "part")
    meet = materialize(whole.unionAll(late).select("id", "own", F.xxhash64("root", "block", "part").alias("chunk")).distinct(), "meet")
    known = meet.select(F.col("id").alias("a"), F.col("own").alias("b"), "chunk")
    return confirmed_links(f, rows, meet.select(F.col("id").alias("rid"), "chunk"), known, known=True)


def component_roots(rows: DataFrame, f: Forest) -> DataFrame:
    """rows (rid, text), rid unique: (rid, n_shingles, root), by what is said at
    near_duplicates."""
    parts = n_parts(rows)
    crowded = crowded_prefixes(f, rows)
    dealt = deal(rows.select("rid", "text").mapInArrow(partial(_map_signatures, f, parts, crowded), BLOB_SCHEMA), parts)
    table = materialize(dealt.mapInArrow(partial(_regions, f, crowded), BLOB_SCHEMA), "forest")
    counts = _rows_of("count", table, ("rid", "n"))
    copies = _rows_of("copy", table, ("a", "b"))
    pairs = materialize(_rows_of("pair", table, ("a", "b")).distinct(), "pairs")
    near = components(_rows_of("near", table, ("a", "b")).unionAll(met(table)))
    sized = near.join(counts, near.id == counts.rid).select("id", "root", "n")
    total = materialize(sized.groupBy("root").agg(F.sum("n").alias("total")).where(F.col("total") > f.room), "large")
    chunks = F.ceil(F.coalesce(F.col("total"), F.lit(1)) / f.room).cast("long")
    placed = materialize(
        sized.join(_hint(total)(total), "root", "left").select("id", "root", "n", chunks.alias("chunks"), F.xxhash64("root", F.pmod(F.xxhash64("id"), chunks)).alias("chunk")), "chunks"
    )
    want = placed.select(F.col("id").alias("rid"), "chunk")
    a = placed.select(F.col("id").alias("a"), F.col("chunk").alias("chunk_a"))
    b = placed.select(F.col("id").alias("b"), F.col("chunk").alias("chunk_b"))
    both = pairs.join(a, "a").join(b, "b")
    inside = both.where("chunk_a = chunk_b").select("a", "b", F.col("chunk_a").alias("chunk"))
    split = bool(placed.where("chunks > 1").limit(1).head(1))
    if split:
        large = placed.where("chunks > 1")
        hint = _hint(large)
        lead = large.groupBy("root").agg(F.slice(F.array_sort(F.collect_set(F.when(F.pmod(F.xxhash64("id"), F.col("chunks") * 1024) == 0, F.col("id")))), 1, 8).alias("lead"))
        lead = lead.join(large.groupBy("root").agg(F.min("id").alias("least")), "root").select("root", F.array_distinct(F.concat(F.array("least"), "lead")).alias("lead"))
        lead = hint(materialize(lead, "lead"))
        each = large.select("root", "chunk").distinct().join(lead, "root").select("chunk", F.explode("lead").alias("rid"))
        star = large.join(lead, "root").select(F.col("id").alias("a"), F.explode("lead").alias("b"), "chunk").where("a <> b")
        want = want.unionAll(each.select("rid", "chunk")).distinct()
        inside = inside.unionAll(star.select("a", "b", "chunk")).distinct()
    # written before components reads it, which needs Python in the same tasks
    links = materialize(copies.unionAll(confirmed_links(f, rows, want, inside)), "links")
    if split:
        known = components(links)
        left = both.where("chunk_a <> chunk_b").select("a", "b")
        left = left.join(known.select(F.col("id").alias("a"), F.col("root").alias("ra")), "a", "left").join(known.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b", "left")
        left = materialize(left.where("not coalesce(ra, a) <=> coalesce(rb, b)").select("a", "b", F.xxhash64("a", "b").alias("chunk")), "between")
        alone = left.select(F.col("a").alias("rid"), "chunk").unionAll(left.select(F.col("b").alias("rid"), "chunk"))
        links = materialize(links.unionAll(confirmed_links(f, rows, alone, left)), "links")
        links = links.unionAll(links_between(f, rows, large.select("id", "root", "n"), links))
    found = components(links)
    return counts.join(found, counts.rid == found.id, "left").select("rid", F.col("n").alias("n_shingles"), F.coalesce("root", "rid").alias("root"))


def near_duplicates(docs: DataFrame, forest: Forest = Forest()) -> DataFrame:
    """Link documents whose sets of word shingles have a similarity of `percent`
    or more, and give each document its component.

    Words are [^\\x20\\x09-\\x0D]+ of the whole text, A-Z lowered. A document's set
    is its distinct 5-word shingles; with fewer words, the whole sequence as
    one; without words or text (null) it is empty and linked with nothing.

    Returns doc_id, n_shingles, component_id (the smallest doc_id reachable),
    kept (it is the component's first). An empty table gives none; other columns
    are ignored. Where doc_id repeats or is null, every row is a document of its
    own, "smallest" means first in the order (doc_id, nulls first; text), and
    kept marks one row of each component.

    Equal sets are collapsed before pairs are formed. Candidates that hang
    together meet in one chunk, up to `room` shingles: their pairs are confirmed,
    and a prefix join finds what links the neighbours have missed, so that no
    window of neighbours decides. Beyond `room` they are dealt out by hash, the
    least document and up to eight others go with every chunk, and pairs of
    neighbours between chunks are confirmed for themselves; then all that is not
    in the largest component so far meets everything, block against block. So
    `room` and `most` change what a task holds, and never a link.
    """
    rows, same = keyed_rows(docs)
    out = component_roots(rows, forest)
    if same:
        return out.select(F.col("rid").alias("doc_id"), "n_shingles", F.col("root").alias("component_id"), (F.col("rid") == F.col("root")).alias("kept"))
    key = rows.select("rid", F.col("key").alias("doc_id"))
    out = out.join(key, "rid").join(key.select(F.col("rid").alias("root"), F.col("doc_id").alias("component_id")), "root")
    return out.select("doc_id", "n_shingles", "component_id", (F.col("rid") == F.col("root")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, forest: Forest = Forest()) -> DataFrame:
    """The first row of each component, with the columns it came with, whatever
    their names. Rows without words (null or empty texts) are kept, each for
    itself; of rows that repeat one is kept; where doc_id repeats or is null rows
    go by (doc_id, nulls first; text). An empty table gives none."""
    rows, _ = keyed_rows(docs, carry=True)
    late = component_roots(rows.select("rid", "text"), forest).where("rid <> root").select("rid")
    return rows.join(late, "rid", "left_anti").select("row.*")


def op9_minhash_forest(spark, sf_dir):
    """Components over all documents at 85 percent."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), Forest())
