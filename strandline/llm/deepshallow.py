"""Deep-shallow suffix sorting, for many groups of suffixes in step.

Shallow: multikey quicksort on big-endian 8-byte characters, three-way around a
median of three, until suffixes are told apart or share `shallow` bytes. Deep:
the groups left over share a long prefix; blind tries order them. A blind trie
keeps for each branch only where it leaves its parent's path and by which byte;
a suffix goes to its branch by one comparison with the path's suffix.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 32


def _words(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place, big-endian, as a view; buf ends in 8 spare
    bytes."""
    return np.ndarray((len(buf) - 8,), ">u8", buf, strides=(1,))


def _at(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    return words[places].astype(np.uint64)


def _elements(lo: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all ranges one after another, and the range of each."""
    which = np.repeat(np.arange(len(lo)), size)
    at = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
    return lo[which] + at, which


def _multikey_quicksort(words, pos, order, shallow, lo, size):
    """Sort ranges of `order` in place; returns those that share `shallow` bytes."""
    depth = np.zeros(len(lo), np.int64)
    deep_lo, deep_size = [], []
    while True:
        live = size > 1
        lo, size, depth = lo[live], size[live], depth[live]
        if not len(lo):
            break
        at, which = _elements(lo, size)
        own = order[at]
        key = _at(words, pos[own] + depth[which])
        base = np.cumsum(size) - size
        a, b, c = key[base], key[base + size // 2], key[base + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[which]
        side = np.where(key < pivot, 0, np.where(key == pivot, 1, 2))
        count = np.bincount(which * 3 + side, minlength=3 * len(lo)).reshape(-1, 3)
        first = np.cumsum(count, axis=1) - count + lo[:, None]
        to = np.empty(len(at), np.int64)
        for k in range(3):
            m = side == k
            seen = np.cumsum(m)
            rank = seen - 1 - (seen[base] - m[base])[which]
            to[m] = (first[:, k][which] + rank)[m]
        order[to] = own
        lo = first.ravel()
        size = count.ravel()
        depth = (depth[:, None] + np.array([0, 8, 0])).ravel()
        deep = (depth >= shallow) & (size > 1)
        deep_lo.append(lo[deep])
        deep_size.append(size[deep])
        lo, size, depth = lo[~deep], size[~deep], depth[~deep]
    return np.concatenate([*deep_lo, np.empty(0, np.int64)]), np.concatenate([*deep_size, np.empty(0, np.int64)])


def _common(words, p, q, depth, limit):
    """Bytes that suffixes p and q share, at most `limit` (of each pair), from a
    depth to which they are known to be equal."""
    shared = depth.copy()
    live = np.flatnonzero(shared < limit)
    while len(live):
        x = _at(words, p[live] + shared[live]) ^ _at(words, q[live] + shared[live])
        same = x == 0
        lead = np.zeros(len(live), np.int64)  # leading bytes that agree
        for j in range(1, 8):
            lead += x < np.uint64(1 << (64 - 8 * j))
        shared[live] += np.where(same, 8, lead)
        live = live[same & (shared[live] < limit[live])]
    return np.minimum(shared, limit)


def _blind_tries(words, pos, order, same, lo, size, shallow, limit):
    """Order each range and mark suffixes equal to the one before to its `limit`."""
    depth = np.full(len(lo), shallow, np.int64)
    while len(lo):
        at, which = _elements(lo, size)
        own = order[at]
        path = pos[order[lo]][which]
        p, end = pos[own], limit[own]
        shared = _common(words, path, p, depth[which], end)
        equal = shared >= end
        reach = np.minimum(shared, end - 1)
        byte = (_at(words, p + reach) >> np.uint64(56)).astype(np.int64)
        below = ~equal & (byte < (_at(words, path + reach) >> np.uint64(56)).astype(np.int64))
        # below the path: early branches first; above it: late branches first
        branch = np.where(equal, 1 << 20, np.where(below, shared * 256 + byte, (1 << 20) + 1 + (end - shared) * 256 + byte))
        key = which * (1 << 22) + branch
        sort = np.argsort(key, kind="stable")
        order[at] = own[sort]
        key, shared, equal = key[sort], shared[sort], equal[sort]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        same[at] = equal & ~new
        start = np.flatnonzero(new)
        count = np.diff(np.append(start, len(key)))
        again = (count > 1) & ~equal[start]
        lo, size, depth = at[start[again]], count[again], shared[start[again]] + 1


def suffix_order(buf: np.ndarray, pos: np.ndarray, limit: int | np.ndarray, shallow: int = SHALLOW, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sort the suffixes of buf that start at pos by their first `limit` bytes (8
    to 4000), all of which must exist. With `group` only suffixes of one group are
    compared, and each group has a limit of its own. Returns the order and, by
    place in it, whether the suffix has the same first `limit` bytes as the one
    before in its group."""
    order = np.arange(len(pos))
    same = np.zeros(len(pos), bool)
    if len(pos):
        limit = np.broadcast_to(np.asarray(limit, np.int64), len(pos))
        least = int(limit.min())
        if least < 8 or int(limit.max()) > 4000:
            raise ValueError("limit must be 8 to 4000 bytes")
        lo = np.array([0])
        if group is not None:
            order = np.argsort(group, kind="stable")
            own = group[order]
            lo = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        size = np.diff(np.append(lo, len(pos)))
        words = _words(np.concatenate([buf, np.zeros(16, np.uint8)]))
        shallow = max(8, min(shallow, least // 8 * 8))
        lo, size = _multikey_quicksort(words, pos, order, shallow, lo, size)
        _blind_tries(words, pos, order, same, lo, size, shallow, limit)
    return order, same
