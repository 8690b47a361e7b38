"""Prefix-partitioned suffix trees over word numbers, written top-down.

Prefixes of variable length split the suffixes into groups that fit in memory:
one word at first, one more wherever a group is still too large. Each group's
tree is built from its root: a node's suffixes that agree on the next word make
its edge longer, others part into children. Nodes that reach `limit` words with
two or more leaves are the deep internal nodes, whose labels are the repeats.
"""

from __future__ import annotations

import numpy as np

GROUP = 1 << 17


def prefix_groups(sym: np.ndarray, pos: np.ndarray, limit: int, most: int = GROUP) -> list[np.ndarray]:
    """Suffix numbers by groups of `most` or fewer; suffixes equal in `limit`
    words stay together whatever their number."""
    done: list[np.ndarray] = []
    todo = [(np.arange(len(pos)), 0)]
    while todo:
        rows, depth = todo.pop()
        if len(rows) <= most or depth == limit:
            done.append(rows)
            continue
        key = sym[pos[rows] + depth]
        order = np.argsort(key, kind="stable")
        cut = np.flatnonzero(np.diff(key[order])) + 1
        small: list[np.ndarray] = []
        held = 0
        for part in np.split(rows[order], cut):
            if len(part) > most:
                todo.append((part, depth + 1))
                continue
            if held + len(part) > most:
                done.append(np.concatenate(small))
                small, held = [], 0
            small.append(part)
            held += len(part)
        if small:
            done.append(np.concatenate(small))
    return done


def deep_nodes(sym: np.ndarray, pos: np.ndarray, limit: int | np.ndarray, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The tree of the suffixes at pos, to `limit` words. With `group` a tree for
    each group, with a limit of its own. Returns the leaves in order and the start
    of each deep node's run of leaves; leaves of no deep node are left out."""
    limit = np.broadcast_to(np.asarray(limit, np.int64), len(pos))
    leaf, lo = np.arange(len(pos)), np.array([0])
    if group is not None:
        leaf = np.argsort(group, kind="stable")
        own = group[leaf]
        lo = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    size = np.diff(np.append(lo, len(pos)))
    deep_lo, deep_size = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    depth = 0
    while True:
        live = size > 1
        lo, size = lo[live], size[live]
        deep = limit[leaf[lo]] <= depth
        if deep.any():
            deep_lo.append(lo[deep])
            deep_size.append(size[deep])
            lo, size = lo[~deep], size[~deep]
        if not len(lo):
            break
        which = np.repeat(np.arange(len(lo)), size)
        base = np.cumsum(size) - size
        at = lo[which] + np.arange(len(which)) - base[which]
        key = sym[pos[leaf[at]] + depth].astype(np.int64)
        depth += 1
        parts = np.minimum.reduceat(key, base) != np.maximum.reduceat(key, base)
        if not parts.any():
            continue
        split = parts[which]
        a, w, k = at[split], which[split], key[split]
        mark = (w << 34) | k
        order = np.argsort(mark, kind="stable")
        leaf[a] = leaf[a[order]]
        mark = mark[order]
        start = np.flatnonzero(np.append(True, mark[1:] != mark[:-1]))
        lo = np.concatenate([lo[~parts], a[start]])
        size = np.concatenate([size[~parts], np.diff(np.append(start, len(mark)))])
    lo, size = np.concatenate(deep_lo), np.concatenate(deep_size)
    base = np.cumsum(size) - size
    which = np.repeat(np.arange(len(lo)), size)
    return leaf[lo[which] + np.arange(len(which)) - base[which]], base


def repeats(sym: np.ndarray, pos: np.ndarray, limit: int, most: int = GROUP) -> tuple[np.ndarray, np.ndarray]:
    """Suffix numbers under deep nodes and the node of each."""
    leaves, nodes, n = [], [], 0
    for rows in prefix_groups(sym, pos, limit, most):
        leaf, base = deep_nodes(sym, pos[rows], limit)
        if len(leaf):
            size = np.diff(np.append(base, len(leaf)))
            leaves.append(rows[leaf])
            nodes.append(n + np.repeat(np.arange(len(base)), size))
            n += len(base)
    if not leaves:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(leaves), np.concatenate(nodes)
