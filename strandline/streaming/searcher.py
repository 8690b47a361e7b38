"""Continuous subspace search: for each column the subspace it depends on most,
kept up to date over a sliding window of rows."""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import kernels
from ..functions.timing import Spent
from ..operators.dataset import dims_of, row_count, windows_of
from .policies import Policy, Scaling

# -- selectors: which columns are searched anew ---------------------------------------------


class Selector:
    """select(scores by column) -> columns; observe(columns, new, old scores)."""

    def select(self, scores: list[float]) -> list[int]:
        raise NotImplementedError

    def observe(self, searched: list[int], new: list[float], old: list[float]) -> None:
        pass


class SelectAll(Selector):
    def select(self, scores):
        return list(range(len(scores)))


class SelectNone(Selector):
    def select(self, scores):
        return []


class SelectWorst(Selector):
    """The n columns with the lowest scores."""

    def __init__(self, n: int = 1):
        self.n = n

    def select(self, scores):
        return sorted(range(len(scores)), key=lambda i: (scores[i], i))[: self.n]


class SelectRandom(Selector):
    def __init__(self, n: int = 1, seed: int = 1):
        self.n, self.rng = n, np.random.default_rng(seed)

    def select(self, scores):
        return sorted(self.rng.permutation(len(scores))[: self.n].tolist())


class SelectBandit(Selector):
    """Thompson sampling with a column as arm; a search is a gain where it raises
    the score by more than the threshold. Without eta n columns are searched;
    with it all at first, then as many as keep the efficiency above eta; a delta
    adds change detection."""

    def __init__(self, d: int, n: int = 1, threshold: float = 0.0, eta: float | None = None, delta: float | None = None, seed: int = 1):
        scaling = Scaling("none", n) if eta is None else Scaling("kl", d, eta, lo=1, hi=d)
        self.threshold = threshold
        self.policy = Policy("mpts" if delta is None else "mpts_adwin", d, scaling, "absolute", 0.5, delta=delta or 0.1, seed=seed)

    def select(self, scores):
        return self.policy.choose()

    def observe(self, searched, new, old):
        self.policy.observe(searched, [float(n - o > self.threshold) for n, o in zip(new, old, strict=True)])


def selector(name: str, d: int, n: int = 1, threshold: float = 0.0, eta: float = 0.5, delta: float = 0.1, seed: int = 1) -> Selector:
    made = {
        "all": lambda: SelectAll(),
        "none": lambda: SelectNone(),
        "random": lambda: SelectRandom(n, seed),
        "worst": lambda: SelectWorst(n),
        "mpts": lambda: SelectBandit(d, n, threshold, seed=seed),
        "sts": lambda: SelectBandit(d, n, threshold, eta, seed=seed),
        "stsadwin": lambda: SelectBandit(d, n, threshold, eta, delta, seed),
    }
    if name not in made:
        raise ValueError(f"no selector {name}")
    return made[name]()


# -- the search ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Search:
    """test, m, alpha, beta: of the estimator. gamma: weight of the old score.
    window, step: rows. monitor: whether scores follow every row, not only
    steps. policy, n: the selector. timings: whether states tell the seconds of
    each row's index, monitoring, decision and search."""

    test: str = "ksp"
    m: int = 20
    alpha: float = 0.5
    beta: float = 0.5
    gamma: float = 0.9
    policy: str = "worst"
    n: int = 1
    threshold: float = 0.0
    eta: float = 0.5
    delta: float = 0.1
    window: int = 100
    step: int = 10
    monitor: bool = True
    seed: int = 1
    timings: bool = False

    @property
    def id(self) -> str:
        return f"{self.test}-{self.gamma}-{self.policy}{self.n}-{self.window}-{self.step}-{self.monitor}"


@dataclass
class Monitor:
    """What is kept between rows: the window, each column's subspace, the score
    it had when searched and the smoothed one."""

    how: Search
    rows: deque = field(default_factory=deque)
    kept: list = field(default_factory=list)
    found: list = field(default_factory=list)
    smooth: list = field(default_factory=list)
    count: int = 1
    chooser: Selector | None = None
    spent: Spent = field(default_factory=Spent)

    def _index(self) -> kernels.WindowIndex:
        return kernels.WindowIndex(np.array(self.rows))

    def _score(self, index, dims, ref: int) -> float:
        h = self.how
        return kernels.deviation(index, dims, ref, h.test, h.m, h.alpha, h.beta, h.seed + self.count)

    def _grow(self, index, ref: int):
        return kernels.greedy_subspace(index, ref, lambda s: self._score(index, s, ref))

    def push(self, row) -> tuple[list, list[float], list[int], int] | None:
        """Take a row; (subspaces, scores, columns searched, searches that found
        another and better subspace), or nothing while the window fills."""
        h, on = self.how, self.spent.on
        self.spent.update(dict.fromkeys(STEPS, 0.0))
        self.rows.append(tuple(float(x) for x in row))
        if len(self.rows) < h.window:
            return None
        if not self.kept:
            d = len(row)
            with on("index"):
                index = self._index()
            with on("search"):
                got = [self._grow(index, r) for r in range(d)]
            self.kept, self.found = [g[0] for g in got], [g[1] for g in got]
            self.smooth = list(self.found)
            self.chooser = selector(h.policy, d, h.n, h.threshold, h.eta, h.delta, h.seed)
            return list(self.kept), list(self.smooth), list(range(d)), 0
        self.rows.popleft()
        searched, success = [], 0
        due = self.count % h.step == 0
        if due or h.monitor:
            with on("index"):
                index = self._index()
            with on("monitor"):
                now = [self._score(index, s, r) if len(s) > 1 else 0.0 for r, s in enumerate(self.kept)]
            self.smooth = [h.gamma * a + (1 - h.gamma) * b for a, b in zip(self.smooth, now, strict=True)]
        if due:
            with on("decision"):
                searched = self.chooser.select(self.found)
            with on("search"):
                got = [self._grow(index, r) for r in searched]
            if searched:
                with on("decision"):
                    self.chooser.observe(searched, [g[1] for g in got], [self.smooth[r] for r in searched])
            for r, (dims, score) in zip(searched, got, strict=True):
                success += score > self.smooth[r] and dims != self.kept[r]
                self.kept[r], self.found[r], self.smooth[r] = dims, score, score
        self.count += 1
        return list(self.kept), list(self.smooth), searched, success


STATE_ROW = "stream string, row_id long, subspaces array<array<int>>, scores array<double>, searched array<int>, success int"
_COLUMNS = ["stream", "row_id", "subspaces", "scores", "searched", "success"]
STEPS = ("index", "monitor", "decision", "search")


def _advance(monitor: Monitor, stream: str, frame: pd.DataFrame, cols: list[str]) -> pd.DataFrame:
    frame = frame.sort_values("row_id")
    out, times = [], STEPS if monitor.how.timings else ()
    for row_id, row in zip(frame["row_id"], frame[cols].to_numpy(float), strict=True):
        got = monitor.push(row)
        if got:
            out.append((stream, int(row_id), [list(s) for s in got[0]], got[1], got[2], int(got[3]), *[monitor.spent[x] for x in times]))
    return pd.DataFrame(out, columns=[*_COLUMNS, *times])


def search_stream(rows: DataFrame, how: Search = Search()) -> DataFrame:
    """rows (stream, row_id, columns), batch or streaming: the state after each
    row from the first full window on. Streams are searched side by side; one
    stream's rows follow each other. A streaming query keeps the window and the
    policy as state, so batch and stream give the same rows. Within a
    micro-batch rows are put in order; later ones than their successors join at
    the end."""
    cols = [c for c in rows.columns if c not in ("stream", "row_id")]
    schema = ", ".join([STATE_ROW, *[f"{x} double" for x in STEPS if how.timings]])
    if not rows.isStreaming:
        return rows.groupBy("stream").applyInPandas(lambda f: _advance(Monitor(how), str(f["stream"].iloc[0]), f, cols), schema)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        monitor = pickle.loads(state.get[0]) if state.exists else Monitor(how)
        out = _advance(monitor, str(key[0]), pd.concat(list(frames)), cols)
        state.update((pickle.dumps(monitor),))
        yield out

    return rows.groupBy("stream").applyInPandasWithState(step, schema, "state binary", "append", GroupStateTimeout.NoTimeout)


# -- contrast over a stream ---------------------------------------------------------------------


def stream_contrast(wide: DataFrame, window: int, step: int, subspaces: list[list[int]] | None = None, gamma: float = 0.9, test: str = "ksp", m: int = 20, alpha: float = 0.5, seed: int = 1) -> DataFrame:
    """(subspace, position, score) for each position of a sliding window. Fresh
    values come at the first position and then every `step`; over the full space
    (subspaces None) every position smooths with the latest one, over given
    subspaces only fresh values are smoothed and the rest carried forward. The
    windows in question are evaluated side by side."""
    cols = dims_of(wide)
    n = row_count(wide)
    sets = subspaces or [list(range(len(cols)))]
    # fresh at position 0 and at 1, 1 + step, ...: windows of step 1, filtered
    rows = windows_of(wide, n, window, 1).where((F.col("window") == 0) | (F.pmod(F.col("window") - 1, F.lit(step)) == 0))

    def score(frame: pd.DataFrame) -> pd.DataFrame:
        at = int(frame["window"].iloc[0])
        index = kernels.WindowIndex(frame.sort_values("row_id")[cols].to_numpy(float))
        return pd.DataFrame([(i, at, kernels.contrast(index, s, test, m, alpha, seed=seed)) for i, s in enumerate(sets)], columns=["subspace", "position", "fresh"])

    fresh = rows.groupBy("window").applyInPandas(score, "subspace int, position long, fresh double")

    def smooth(frame: pd.DataFrame) -> pd.DataFrame:
        got = dict(zip(frame["position"], frame["fresh"], strict=True))
        value = latest = got[0]
        out = [(int(frame["subspace"].iloc[0]), 0, value)]
        for p in range(1, n - window + 1):
            new = p in got
            latest = got.get(p, latest)
            if subspaces is None or new:
                value = gamma * value + (1 - gamma) * latest
            out.append((out[0][0], p, value))
        return pd.DataFrame(out, columns=["subspace", "position", "score"])

    return fresh.groupBy("subspace").applyInPandas(smooth, "subspace int, position long, score double")
