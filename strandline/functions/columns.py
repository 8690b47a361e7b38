"""Dependence of columns in a window of any length: columns lie packed and are
read one at a time, walks go over bits. The numbers are those of kernels.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np

from . import kernels
from .draws import draw_np
from .special import kolmogorov_np

WORD = 64  # ranks in a word of bits
CELLS = 1 << 16  # comparisons made at once
WORDS = 1 << 14  # words walked at once
HELD = 1 << 26  # bytes of a window's columns that a task keeps in memory


def width(n: int) -> int:
    """Bytes of a rank."""
    return 2 if n <= 1 << 16 else 3 if n <= 1 << 24 else 4


def packed(rank: np.ndarray, n: int) -> bytes:
    """Ranks among n, in as few bytes as they need."""
    return rank.astype("<i4").view(np.uint8).reshape(-1, 4)[:, : width(n)].tobytes()


class FiledIndex(kernels.WindowIndex):
    """A window's columns as packed ranks (and values, where a test needs them)
    by row: in files, or in memory up to HELD bytes. Only the last reference
    column's order and ties are held otherwise."""

    def __init__(self, folder: str, n: int, d: int):
        self.folder, self.n, self.d, self.kinds = Path(folder), n, d, "n" * d
        self._ties: dict[int, tuple] = {}
        self._order: tuple[int, np.ndarray] | None = None
        self._memory: dict[tuple, bytearray] = {}

    def put(self, kind: str, j: int, at: int, block: bytes) -> None:
        """Column j's ranks or cells from row at on."""
        size = width(self.n) if kind == "ranks" else 8
        if self.n * self.d * size <= HELD:
            whole = self._memory.setdefault((kind, j), bytearray(self.n * size))
            whole[at * size : at * size + len(block)] = block
            return
        file = self.folder / f"{j}.{kind}"
        with file.open("r+b" if file.exists() else "wb") as f:
            f.seek(at * size)
            f.write(block)

    def _read(self, kind: str, j: int) -> np.ndarray:
        if not self.n:
            return np.zeros(0, np.uint8)
        if (kind, j) in self._memory:
            return np.frombuffer(self._memory[kind, j], np.uint8)
        return np.fromfile(self.folder / f"{j}.{kind}", np.uint8)

    def rank_of(self, j: int) -> np.ndarray:
        out = np.zeros((self.n, 4), np.uint8)
        out[:, : width(self.n)] = self._read("ranks", j).reshape(self.n, width(self.n))
        return out.view("<i4").ravel()

    def values_of(self, j: int) -> np.ndarray:
        return self._read("cells", j).view(float)

    def order_of(self, j: int) -> np.ndarray:
        if self._order is None or self._order[0] != j:
            order = np.empty(self.n, np.intp)
            order[self.rank_of(j)] = np.arange(self.n)
            self._order = j, order
        return self._order[1]

    def ties(self, j: int):
        if j not in self._ties:
            self._ties.clear()
        return super().ties(j)


def slice_bits(rank: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """For each start in at the ranks from there on, size of them: a bit for each
    rank, in words; bits behind the last are 0."""
    out = np.zeros((len(at), -(-len(rank) // WORD) * (WORD // 8)), np.uint8)
    at = at.astype(np.int32)[:, None]
    step = max(CELLS // len(at) // WORD, 1) * WORD
    for a in range(0, len(rank), step):
        # below the start the difference wraps to a large number
        got = np.packbits((rank[a : a + step] - at).view(np.uint32) < np.uint32(size), axis=1)
        out[:, a // 8 : a // 8 + got.shape[1]] = got
    return out.view(np.uint64)


def _walks(bits: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    count = np.bitwise_count(bits).astype(np.int64)
    inside = np.cumsum(count, axis=1)
    m = inside[:, -1]
    gap = inside * n - np.minimum(np.arange(1, bits.shape[1] + 1) * WORD, n) * m[:, None]
    top = np.abs(gap).max(axis=1)
    start = np.zeros_like(gap)
    start[:, 1:] = gap[:, :-1]
    # only words in which the walk can go beyond its ends are walked
    reach = np.maximum(start + count * (n - m)[:, None], (WORD - count) * m[:, None] - start)
    i, w = np.nonzero(reach > top[:, None])
    if len(i):
        ones = np.unpackbits(bits[i, w].view(np.uint8).reshape(-1, WORD // 8), axis=1)
        k = np.arange(1, WORD + 1)
        walk = np.cumsum(ones, axis=1, dtype=np.int64) * n - k * m[i][:, None] + start[i, w][:, None]
        walk[w[:, None] * WORD + k > n] = 0
        np.maximum.at(top, i, np.abs(walk).max(axis=1))
    return top, m


def walks(bits: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of bits over n ranks what ks_parts gives: (largest |in * m_out
    - out * m_in|, m_in)."""
    if not n:
        return np.zeros(len(bits), np.int64), np.zeros(len(bits), np.int64)
    some = max(WORDS // bits.shape[1], 1)
    parts = [_walks(bits[a : a + some], n) for a in range(0, len(bits), some)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


class Reference:
    """Kolmogorov-Smirnov tests of one reference column, many iterations at once."""

    def __init__(self, index: FiledIndex, ref: int, test: str, its: np.ndarray, alpha: float, seed: int):
        self.index, self.ref, self.test, self.its, self.alpha, self.seed = index, ref, test, its, alpha, seed
        self.order = index.order_of(ref)[:-1]  # the last rank is left out
        self._held: tuple | None = None

    def _slices(self, j: int, size: int) -> np.ndarray:
        at = draw_np(self.seed, self.its, j) % max(self.index.n - size, 1)
        return slice_bits(self.index.rank_of(j)[self.order], at, size)

    def _all(self, dims: list[int], size: int) -> np.ndarray:
        """Held until other columns or another size are asked for: a search tries
        many columns beside the same ones."""
        if self._held is None or self._held[0] != (dims, size):
            bits = self._slices(dims[0], size)
            for j in dims[1:]:
                bits &= self._slices(j, size)
            self._held = (dims, size), bits
        return self._held[1]

    def scores(self, dims) -> np.ndarray:
        size, others = kernels.slice_size(self.index.n, self.alpha, len(dims)), [j for j in dims if j != self.ref]
        bits = self._slices(others[-1], size)
        if len(others) > 1:
            bits &= self._all(others[:-1], size)
        n = len(self.order)
        top, m = walks(bits, n)
        top, m = [int(x) for x in top], [int(x) for x in m]
        if self.test == "ks":
            return np.array([t / (x * n) if x else 1.0 for t, x in zip(top, m, strict=True)])
        z = [t / (x * (n - x)) * np.sqrt(x * (n - x) // n) if 0 < x < n else 0.0 for t, x in zip(top, m, strict=True)]
        return np.where([0 < x < n for x in m], kolmogorov_np(z), 1.0)


def _mean(scores: np.ndarray) -> float:
    """Added in turn, as kernels does."""
    return float(np.cumsum(scores)[-1]) / len(scores)


def walked(test: str) -> bool:
    """Is the test a walk, where all columns are numeric?"""
    return test in ("ks", "ksp", "mcdep")


def deviation(index: FiledIndex, dims, ref: int, test: str, m: int, alpha: float, beta: float, seed: int) -> float:
    if not walked(test):
        return kernels.deviation(index, dims, ref, test, m, alpha, beta, seed)
    return _mean(Reference(index, ref, test, np.arange(m), alpha, seed).scores(sorted(dims)))


def contrast(index: FiledIndex, dims, test: str, m: int, alpha: float, beta: float, seed: int) -> float:
    if not walked(test):
        return kernels.contrast(index, dims, test, m, alpha, beta, seed)
    dims, its, scores = sorted(dims), np.arange(m), np.empty(m)
    refs = draw_np(seed, its, kernels.REF_KEY) % len(dims)
    for i in np.unique(refs):
        scores[refs == i] = Reference(index, dims[i], test, its[refs == i], alpha, seed).scores(dims)
    return _mean(scores)


def greedy_subspace(index: FiledIndex, ref: int, test: str, m: int, alpha: float, beta: float, seed: int) -> tuple[tuple[int, ...], float]:
    if not walked(test):
        return kernels.greedy_subspace(index, ref, lambda s: kernels.deviation(index, s, ref, test, m, alpha, beta, seed))
    own = Reference(index, ref, test, np.arange(m), alpha, seed)
    return kernels.greedy_subspace(index, ref, lambda s: _mean(own.scores(s)))
