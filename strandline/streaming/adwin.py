"""Adaptive windowing for change detection (Bifet and Gavalda, 2007): a window
that shrinks wherever two parts of it differ in their means."""

from __future__ import annotations

import math


class Adwin:
    """The window is kept as buckets of sizes 1, 2, 4, ..., at most ROW of each:
    logarithmic memory. Every CHECK values, cuts between buckets are tried."""

    ROW, CHECK, LEAST, SIDE = 5, 32, 10, 6

    def __init__(self, delta: float = 0.002):
        self.delta = delta
        self.rows: list[list[tuple[float, float]]] = [[]]  # by level, newest first: (sum, squared deviations)
        self.width, self.total, self.variance, self.seen = 0, 0.0, 0.0, 0
        self.detected = False

    @property
    def mean(self) -> float:
        return self.total / self.width if self.width else 0.0

    def add(self, x: float) -> bool:
        """Take a value; whether the window was cut."""
        if self.width:
            self.variance += self.width * (x - self.mean) ** 2 / (self.width + 1)
        self.width, self.total, self.seen = self.width + 1, self.total + x, self.seen + 1
        self.rows[0].insert(0, (x, 0.0))
        level = 0
        while len(self.rows[level]) > self.ROW:
            (s2, v2), (s1, v1) = self.rows[level].pop(), self.rows[level].pop()
            n = 1 << level
            if level + 1 == len(self.rows):
                self.rows.append([])
            self.rows[level + 1].insert(0, (s1 + s2, v1 + v2 + (s1 - s2) ** 2 / (2 * n)))
            level += 1
        self.detected = False
        if self.seen % self.CHECK == 0 and self.width > self.LEAST:
            while self._cut():
                self.detected = True
        return self.detected

    def _cut(self) -> bool:
        """Drop the oldest bucket if some cut shows a change."""
        n0, s0 = 0, 0.0
        spread = self.variance / self.width
        log = math.log(2 * math.log(self.width) / self.delta)
        for level in range(len(self.rows) - 1, -1, -1):
            for s, _ in reversed(self.rows[level]):
                n0, s0 = n0 + (1 << level), s0 + s
                n1 = self.width - n0
                if n1 < self.SIDE:
                    return False
                if n0 < self.SIDE:
                    continue
                m = 1 / (n0 - self.SIDE + 2) + 1 / (n1 - self.SIDE + 2)
                if abs(s0 / n0 - (self.total - s0) / n1) > math.sqrt(2 * m * spread * log) + 2 / 3 * m * log:
                    self._drop()
                    return self.width > self.LEAST
        return False

    def _drop(self) -> None:
        level = max(i for i, r in enumerate(self.rows) if r)
        s, v = self.rows[level].pop()
        n = 1 << level
        self.width, self.total = self.width - n, self.total - s
        self.variance = max(0.0, self.variance - v - (n * self.width * (s / n - self.total / max(self.width, 1)) ** 2 / (n + self.width) if self.width else 0.0))


class SharedAdwin:
    """One window for each of several arms."""

    def __init__(self, arms: int, delta: float = 0.1):
        self.windows = [Adwin(delta) for _ in range(arms)]

    def add(self, arm: int, x: float) -> bool:
        return self.windows[arm].add(x)

    def size(self) -> int:
        return min(w.width for w in self.windows)

    def sizes(self) -> list[int]:
        return [w.width for w in self.windows]

    def smallest(self, arms: list[int] | None = None) -> tuple[int, int]:
        """(arm, width) of the smallest window, among some arms if given."""
        return min(((a, self.windows[a].width) for a in (arms if arms is not None else range(len(self.windows)))), key=lambda x: (x[1], x[0]))

    def detected(self) -> bool:
        return any(w.detected for w in self.windows)
