"""Indexes of one column over a sliding window: kept row by row as a stream's
state, or built for all windows side by side from a table."""

from __future__ import annotations

import math
import pickle
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import ranks
from ..operators.dataset import windows_of
from ..plans.running import running_by


def _key(value) -> tuple[int, float]:
    """Numbers, and after them null and NaN as one value. Both zeros are one."""
    return (1, 0.0) if value is None or math.isnan(value) else (0, float(value) + 0.0)


class SlidingRanks:
    """The window's values in order, equal ones by arrival. An insert drops the
    oldest value. Positions count from the window's oldest row as of the last
    refresh, so values that came since have positions beyond the window."""

    def __init__(self, values: Iterable = ()):
        self.queue = deque(values)
        self.base = self.oldest = 0
        self.order = sorted((_key(v), i) for i, v in enumerate(self.queue))
        self.values = dict(enumerate(self.queue))
        self.refresh()

    def __len__(self) -> int:
        return len(self.queue)

    def __getitem__(self, i: int) -> tuple:
        arrival = self.order[i][1]
        return arrival - self.base, self.values[arrival]

    def grow(self, value) -> None:
        """Take a value and drop none."""
        arrival = self.oldest + len(self.queue)
        self.queue.append(value)
        self.values[arrival] = value
        insort(self.order, (_key(value), arrival))

    def insert(self, value) -> None:
        if not self.queue:
            raise ValueError("an empty window has no oldest row to drop")
        gone = self.oldest
        del self.order[bisect_left(self.order, (_key(self.queue.popleft()), gone))], self.values[gone]
        self.oldest += 1
        self.grow(value)

    def refresh(self) -> None:
        self.base = self.oldest

    def rows(self) -> list[tuple]:
        """(position, value, rank, correction, ties), by rank."""
        return [(*self[i], float(i), None, None) for i in range(len(self))]


class SlidingCorrected(SlidingRanks):
    """With ranks averaged over ties and the sum of t^3 - t over tie groups so
    far. Both are as of the last refresh, and -1 for values that came since."""

    def refresh(self) -> None:
        super().refresh()
        self.known, at, so_far = {}, 0, 0.0
        while at < len(self.order):
            to = bisect_left(self.order, (self.order[at][0], math.inf))
            t = float(to - at)
            so_far += t * t * t - t
            self.known |= {a: (at + (t - 1) / 2, so_far, to - at) for _, a in self.order[at:to]}
            at = to

    def __getitem__(self, i: int) -> tuple:
        return (*super().__getitem__(i), *self.known.get(self.order[i][1], (-1.0, -1.0, -1))[:2])

    def rows(self) -> list[tuple]:
        return [(*self[i], self.known.get(a, (0, 0, -1))[2]) for i, (_, a) in enumerate(self.order)]


class SlidingCounts:
    """Of each value in the window its positions, oldest first, and their number."""

    def __init__(self, values: Iterable = ()):
        self.queue, self.base, self.oldest = deque(), 0, 0
        self.held: dict[tuple, deque] = {}
        for v in values:
            self.grow(v)

    def __len__(self) -> int:
        return len(self.queue)

    def __getitem__(self, value) -> tuple[list[int], int]:
        found = [a - self.base for a in self.held.get(_key(value), ())]
        return found, len(found)

    def __contains__(self, value) -> bool:
        return _key(value) in self.held

    def grow(self, value) -> None:
        self.held.setdefault(_key(value), deque()).append(self.oldest + len(self.queue))
        self.queue.append(value)

    def insert(self, value) -> None:
        if not self.queue:
            raise ValueError("an empty window has no oldest row to drop")
        key = _key(self.queue.popleft())
        self.held[key].popleft()
        if not self.held[key]:
            del self.held[key]
        self.oldest += 1
        self.grow(value)

    def refresh(self) -> None:
        self.base = self.oldest

    def rows(self) -> list[tuple]:
        """(position, value, rank, correction, ties), the rank by distinct value."""
        window, code = list(self.queue), {k: i for i, k in enumerate(sorted(self.held))}
        return [(p, window[p], float(code[_key(window[p])]), None, self[window[p]][1]) for p in range(len(window))]


KINDS = {"n": SlidingRanks, "o": SlidingCorrected, "c": SlidingCounts}
INDEX_ROW = "stream string, dim int, upto long, pos long, value double, rk double, correction double, ties long"
_COLUMNS = ["stream", "dim", "upto", "pos", "value", "rk", "correction", "ties"]


def to_stream(values: Iterable, kind: str = "n") -> SlidingRanks | SlidingCounts:
    """A table's column, oldest row first, as the state that a stream continues."""
    return KINDS[kind](values)


def _advance(state: list, key: tuple, frame: pd.DataFrame, size: int, step: int) -> pd.DataFrame:
    index, seen = state
    out = []
    for v in frame.sort_values("row_id")["v"].tolist():
        index.grow(v) if len(index) < size else index.insert(v)
        seen += 1
        if seen >= size and (seen - size) % step == 0:
            index.refresh()
            out += [(str(key[0]), int(key[1]), seen - 1, *r) for r in index.rows()]
    state[1] = seen
    return pd.DataFrame(out, columns=_COLUMNS).astype({"value": float, "rk": float, "correction": float, "ties": "Int64"})


def index_stream(long: DataFrame, size: int, step: int, kind: str = "n") -> DataFrame:
    """long (stream, dim, row_id, v): the index of each column over the latest
    `size` rows, after the first full window and every `step` rows then. kind n
    gives ranks, o ranks averaged over ties with their correction, c the rank of
    the distinct value and its count. upto: how many rows of the stream came before
    the window's last; pos: place in the window, oldest 0.

    Null and NaN are one value after all numbers, given back as null; ties go by
    arrival. A stream shorter than a window and an empty table give no
    rows; other columns are left out. A table's windows are built side by side,
    so a stream with a third of all rows spreads over as many tasks as it fills.
    A streaming query keeps one window for each column as state; rows of a
    micro-batch are put in order, later ones join at the end."""
    if kind not in KINDS:
        raise ValueError(f"no index of kind {kind}")
    if size < 1 or step < 1:
        raise ValueError("a window and its step hold a row or more")
    long = long.select(F.col("stream").cast("string").alias("stream"), "dim", "row_id", F.coalesce(F.col("v").cast("double"), F.lit(float("nan"))).alias("v"))
    if not long.isStreaming:
        return _index_table(long, size, step, kind)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else [KINDS[kind](), 0]
        out = _advance(held, key, pd.concat(list(frames)), size, step)
        state.update((pickle.dumps(held),))
        yield out

    return long.groupBy("stream", "dim").applyInPandasWithState(run, INDEX_ROW, "state binary", "append", GroupStateTimeout.NoTimeout)


def _index_table(long: DataFrame, size: int, step: int, kind: str) -> DataFrame:
    placed = running_by(long, ["stream", "dim"], [F.col("row_id")], {}).withColumnRenamed("row_id", "given").withColumnRenamed("place", "row_id")
    rows = windows_of(placed, F.lit((1 << 62)), size, step)  # windows that don't fill go below
    keys = ("stream", "dim", "window")
    rows = rows.withColumn("__n", F.count("*").over(W.partitionBy(*keys))).where(F.col("__n") == size)
    if kind == "n":
        got = ranks.rank_index(rows, keys).withColumns({"rank": F.col("rk").cast("double"), "corr": F.lit(None), "t": F.lit(None)})
    elif kind == "o":
        got = ranks.corrected_index(rows, keys).withColumns({"rank": F.col("adj"), "corr": F.col("correction"), "t": F.col("ties")})
    else:
        w = W.partitionBy(*keys)
        got = rows.withColumns({"rank": (F.dense_rank().over(w.orderBy("v")) - 1).cast("double"), "corr": F.lit(None), "t": F.count("*").over(W.partitionBy(*keys, "v"))})
    first = F.col("window") * step
    return got.select(
        "stream", F.col("dim").cast("int").alias("dim"), (first + size - 1).alias("upto"), (F.col("row_id") - first).alias("pos"),
        F.expr("nullif(v, double('NaN'))").alias("value"), F.col("rank").cast("double").alias("rk"), F.col("corr").cast("double").alias("correction"), F.col("t").cast("long").alias("ties"),
    )
