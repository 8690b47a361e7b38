"""Dependence of columns in one window, in numpy: what loops that depend on
their own results (searches, streams) call many times.

A window is a matrix (rows by columns). The numbers are those of the DataFrame
operators: the same draws, ranks, slices and tests.
"""

from __future__ import annotations

import math

import numpy as np

from .draws import draw_np
from .special import chi_squared_cdf_np, kolmogorov_np

REF_KEY = 100003  # draws of the reference column


class WindowIndex:
    """Ranks of every column of a window, by the kind of column."""

    def __init__(self, rows: np.ndarray, kinds: str | None = None):
        self.rows = np.asarray(rows, float)
        self.n, self.d = self.rows.shape
        self.kinds = kinds or "n" * self.d
        self.order = np.argsort(self.rows, axis=0, kind="stable")
        self.rank = np.empty_like(self.order)
        for j in range(self.d):
            self.rank[self.order[:, j], j] = np.arange(self.n)
        self._ties: dict[int, tuple] = {}

    def rank_of(self, j: int) -> np.ndarray:
        return self.rank[:, j]

    def order_of(self, j: int) -> np.ndarray:
        return self.order[:, j]

    def values_of(self, j: int) -> np.ndarray:
        return self.rows[:, j]

    def ties(self, j: int):
        """Sorted values, tie boundaries, averaged ranks and cumulative tie
        correction of column j, by rank."""
        if j not in self._ties:
            v = self.values_of(j)[self.order_of(j)]
            start = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
            t = np.diff(np.append(start, self.n))
            group = np.repeat(np.arange(len(t)), t)
            adj = (start + (t - 1) / 2)[group]
            self._ties[j] = v, np.append(start, self.n), adj, np.cumsum(t**3 - t)[group]
        return self._ties[j]

    def safe_cut(self, j: int, cut: int) -> int:
        b = self.ties(j)[1]
        right = int(b[min(np.searchsorted(b, cut), len(b) - 1)])
        left = int(b[np.searchsorted(b, cut, side="right") - 1])
        return left if cut - left < right - cut else right


def slice_size(n: int, alpha: float, d: int) -> int:
    if d < 2:
        raise ValueError("a subspace has two columns at least")
    return math.ceil(alpha ** (1 / (d - 1)) * n)


def slice_of(index: WindowIndex, j: int, size: int, it: int, seed: int) -> np.ndarray:
    """Rows in a random slice of column j."""
    n, kind = index.n, index.kinds[j]
    at = int(draw_np(seed, it, j)) % max(n - size, 1)
    rank = index.rank_of(j)
    if kind == "n":
        return (rank >= at) & (rank < at + size)
    if kind == "o":
        a = index.safe_cut(j, at)
        b = index.safe_cut(j, min(a + size, n - 1))
        core = (rank >= a) & (rank < b)
    else:
        values, code = np.unique(index.values_of(j), return_inverse=True)
        k = max(min(max(math.floor(len(values) * size / n), 1), len(values) - 1), 0)
        turn = np.lexsort((np.arange(len(values)), draw_np(seed, it, np.arange(len(values)))))
        core = np.isin(code, turn[:k])
    pick = np.lexsort((np.arange(n), draw_np(seed + 1, it, np.arange(n)), ~core))[:size]
    out = np.zeros(n, bool)
    out[pick] = True
    return out


def ks_parts(inside: np.ndarray) -> tuple[int, int, int]:
    """inside by reference rank: (largest |in * m_out - out * m_in|, m_in, m_out)
    over all ranks but the last, which the reference leaves out."""
    s = inside[:-1]
    a, m = np.cumsum(s), int(s.sum())
    out = len(s) - m
    b = np.arange(1, len(s) + 1) - a
    return (int(np.abs(a * out - b * m).max()) if len(s) else 0), m, out


def ks(inside: np.ndarray) -> float:
    """Distance between the slice and all."""
    s = inside[:-1]
    m, n = int(s.sum()), len(s)
    if m == 0:
        return 1.0
    return float(np.abs(np.cumsum(s) * n - np.arange(1, n + 1) * m).max()) / (m * n)


def ksp(inside: np.ndarray) -> float:
    top, m, out = ks_parts(inside)
    if m == 0 or out == 0:
        return 1.0
    z = top / (m * out) * math.sqrt((m * out) // (m + out))
    return float(kolmogorov_np(z)[0])


def mwp(index: WindowIndex, ref: int, inside: np.ndarray, beta: float, it: int, seed: int) -> float:
    """Mann-Whitney in a random restriction of the reference column."""
    v, bounds, adj, tie = index.ties(ref)
    n = index.n
    free = int(n * (1 - beta))
    a = index.safe_cut(ref, int(draw_np(seed + 2, it, REF_KEY)) % free if free else 0)
    b = index.safe_cut(ref, min(a + int(n * beta), n - 1))
    if a == n or v[a] == v[b - 1]:
        if a > 0:
            a = int(bounds[np.searchsorted(bounds, a) - 1])
        elif b < n:
            b = int(bounds[np.searchsorted(bounds, b, side="right")])
    s = inside[a:b]
    n1, length = int(s.sum()), b - a
    if n1 in (0, length):
        return 1.0
    n2 = length - n1
    u = float(adj[a:b][s].sum()) - a * n1 - (n1 * (n1 - 1)) // 2
    correction = (float(tie[b - 1]) - (0.0 if a == 0 else float(tie[a - 1]))) / (length * (length - 1.0))
    spread = n1 * n2 / 12 * (length + 1 - correction)
    if spread <= 0:
        return 0.0
    return math.erf(abs(u - n1 * n2 / 2) / math.sqrt(spread) / math.sqrt(2))


def csp(values: np.ndarray, inside: np.ndarray) -> float:
    """Chi-squared over the categories of the reference column."""
    names, code = np.unique(values, return_inverse=True)
    n1, n = int(inside.sum()), len(values)
    if len(names) == 1:
        return 0.0
    if n1 in (0, n):
        return 1.0
    o1 = np.bincount(code, weights=inside, minlength=len(names))
    total = np.bincount(code, minlength=len(names))
    e1, e2 = total * n1 / n, total * (n - n1) / n
    x = float(((o1 - e1) ** 2 / e1 + ((total - o1) - e2) ** 2 / e2).sum())
    return chi_squared_cdf_np(x, len(names) - 1)


TESTS = ("ks", "ksp", "mwp", "csp", "mcdep")


def two_sample(index: WindowIndex, test: str, ref: int, selected: np.ndarray, beta: float, it: int, seed: int) -> float:
    """selected: rows of the window that lie in the slice."""
    if test == "mcdep":
        test = {"n": "ksp", "o": "mwp", "c": "csp"}[index.kinds[ref]]
    if test == "csp":
        return csp(index.values_of(ref), selected)
    inside = selected[index.order_of(ref)]
    if test == "mwp":
        return mwp(index, ref, inside, beta, it, seed)
    return ks(inside) if test == "ks" else ksp(inside)


def _mean(index: WindowIndex, dims: list[int], ref_of, test: str, m: int, alpha: float, beta: float, seed: int) -> float:
    size, total = slice_size(index.n, alpha, len(dims)), 0.0
    for it in range(m):
        ref = ref_of(it)
        selected = np.ones(index.n, bool)
        for j in dims:
            if j != ref:
                selected &= slice_of(index, j, size, it, seed)
        total += two_sample(index, test, ref, selected, beta, it, seed)
    return total / m


def deviation(index: WindowIndex, dims, ref: int, test: str = "ksp", m: int = 50, alpha: float = 0.5, beta: float = 0.5, seed: int = 1) -> float:
    """How much the reference column depends on the others of the subspace."""
    return _mean(index, sorted(dims), lambda it: ref, test, m, alpha, beta, seed)


def contrast(index: WindowIndex, dims, test: str = "ksp", m: int = 50, alpha: float = 0.5, beta: float = 0.5, seed: int = 1) -> float:
    """The same with a reference column drawn in each iteration."""
    dims = sorted(dims)
    return _mean(index, dims, lambda it: dims[int(draw_np(seed, it, REF_KEY)) % len(dims)], test, m, alpha, beta, seed)


def greedy_subspace(index: WindowIndex, ref: int, score) -> tuple[tuple[int, ...], float]:
    """Order the other columns by how far ref deviates with each alone, then add
    each that raises the deviation. score(dims) is the deviation of ref."""
    alone = {x: score((ref, x)) for x in range(index.d) if x != ref}
    best, top = (ref,), 0.0
    for x in sorted(alone, key=lambda x: (-alone[x], x)):
        got = score((*best, x))
        if got > top:
            best, top = (*best, x), got
    return tuple(sorted(best)), top
