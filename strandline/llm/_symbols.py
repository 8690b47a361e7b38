"""Texts as sequences of 64-bit symbols (bytes or hashed words), rolling hashes
over them, and content-defined anchors."""

from __future__ import annotations

import numpy as np

from ._common import mix64

CHUNK = 1 << 16
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEP = np.zeros(256, bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Everything in ASCII but letters and digits ends a term.
_NO_TERM = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK + 1024)
        for k, b in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def prefix(sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of sym[i] * base**i, and the inverse powers: the hash of
    sym[a:b] is (p[b] - p[a]) * down[a]."""
    up, down = powers(len(sym) + 1)
    p = np.zeros(len(sym) + 1, np.uint64)
    np.cumsum(sym * up[: len(sym)], out=p[1:])
    return p, down


def word_spans(off: np.ndarray, buf: np.ndarray, terms: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words [^\\x20\\x09-\\x0D]+ in a run of texts, and the
    index of each text's first word (one more at the end). With terms: of runs of
    letters, digits and whatever isn't ASCII."""
    n = len(buf)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    word = ~(_NO_TERM if terms else _SEP)[buf]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | edge[1:n]
    end = word.copy()
    end[:-1] &= ~word[1:] | edge[1:n]
    ws, we = np.flatnonzero(start), np.flatnonzero(end) + 1
    return ws, we, np.searchsorted(ws, off)


def word_hashes(buf: np.ndarray, ws: np.ndarray, we: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes, with A-Z lowered if asked."""
    out = np.empty(len(ws), np.uint64)
    if not len(ws):
        return out
    table = _TABLE[_LOWER] if lower else _TABLE
    cuts = np.searchsorted(ws, np.arange(0, int(ws[-1]) + CHUNK + 1, CHUNK))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a == b:
            continue
        lo, hi = ws[a], we[b - 1]
        p, down = prefix(table[buf[lo:hi]])
        s, e = ws[a:b] - lo, we[a:b] - lo
        out[a:b] = mix64((p[e] - p[s]) * down[s] + (e - s).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    return out


def word_numbers(buf: np.ndarray, ws: np.ndarray, we: np.ndarray) -> np.ndarray:
    """A number for each word, the same for equal words alone: hashes group the
    words, their bytes decide."""
    if not len(ws):
        return np.empty(0, np.int64)
    _, first, number = np.unique(word_hashes(buf, ws, we), return_index=True, return_inverse=True)
    own = first[number]
    n = we - ws
    wrong = n != n[own]
    eight = np.ndarray((len(buf) + 8,), "<u8", np.concatenate([buf, np.zeros(16, np.uint8)]), strides=(1,))
    left = np.flatnonzero((own != np.arange(len(ws))) & ~wrong)
    for i in left[n[left] > 4096].tolist():
        wrong[i] = not np.array_equal(buf[ws[i] : we[i]], buf[ws[own[i]] : we[own[i]]])
    left, at = left[n[left] <= 4096], 0
    while len(left):
        x = eight[ws[left] + at] ^ eight[ws[own[left]] + at]
        rest = n[left] - at
        # bytes behind a word's end don't count
        x <<= np.where(rest < 8, 64 - 8 * np.minimum(rest, 8), 0).astype(np.uint64)
        wrong[left[x != 0]] = True
        left, at = left[(x == 0) & (rest > 8)], at + 8
    if wrong.any():  # two words of one hash
        raw, seen = buf.tobytes(), {}
        number = np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(ws.tolist(), we.tolist(), strict=True)])
    return number


def window_hashes(sym: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` symbols, computed in chunks."""
    n = len(sym) - width + 1
    out = np.empty(max(n, 0), np.uint64)
    for c in range(0, max(n, 0), CHUNK):
        s = sym[c : min(n, c + CHUNK) + width - 1]
        p, down = prefix(s)
        m = len(s) - width + 1
        out[c : c + m] = mix64((p[width:] - p[:-width]) * down[:m])
    return out


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    return np.minimum(v[: len(v) - (width - span)], v[width - span :]) if span < width else v


def anchors(get, off: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Anchors of all windows of `length` symbols that lie within one text.

    Of the k-grams in a window the one with the smallest hash (the leftmost
    such) is its anchor, so equal windows have equal anchors at the same place.
    Windows that share an anchor are consecutive: they form one segment, from
    the first window's start to the last one's end. get(a, b) gives the symbols
    a to b of the run of texts. Returns, by segment: first window start, number
    of windows, hash of the anchor, hash of the segment.
    """
    n = int(off[-1])
    out: list[tuple[np.ndarray, ...]] = []
    first, last = off[:-1], off[1:] - length + 1
    ok = last > first
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, first[ok], 1)
    np.add.at(step, last[ok], -1)
    valid = np.cumsum(step)[:n] > 0
    bits = _U((1 << 17) - 1)
    for c in range(0, n - length + 1, CHUNK):
        sym = get(c, min(n, c + CHUNK + length - 1))
        p, down = prefix(sym)
        m = len(sym) - k + 1
        h = mix64((p[k:] - p[:-k]) * down[:m])
        least = _sliding_min((h & ~bits) | np.arange(m, dtype=np.uint64), length - k + 1)
        at = (least & bits).astype(np.int64)
        v = valid[c : c + len(at)]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | ~v[:-1]
        done = np.ones(len(at), bool)
        done[:-1] = (at[:-1] != at[1:]) | ~v[1:]
        s, e = np.flatnonzero(new & v), np.flatnonzero(done & v)
        g = mix64((p[e + length] - p[s]) * down[s] + (e - s).astype(np.uint64) * _U(0xA24BAED4963EE407))
        out.append((s + c, e - s + 1, h[at[s]], g))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def byte_getter(buf: np.ndarray):
    return lambda a, b: _TABLE[buf[a:b]]
