"""Sequential policies that choose which arms to pull at each step, their
rewards and the scaling of their number. One step needs the results of the one
before, so a policy is a state machine; Spark runs (policy, repetition) groups
side by side."""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import kl_upper
from .adwin import SharedAdwin

# -- rewards ---------------------------------------------------------------------------

REWARDS = {
    "absolute": lambda new, old, limit: float(abs(new) >= limit),
    "relative": lambda new, old, limit: float(abs(new - old) > limit),
    "score": lambda new, old, limit: abs(new),
}

# -- scaling: the next number of arms -----------------------------------------------------


@dataclass(frozen=True)
class Scaling:
    """kind: none, naive1 (by a factor), naive2 (by one, last step's efficiency),
    naive3 (by one, cumulative efficiency), kl and klplus (by one, cumulative
    efficiency of the arms played; up where the next arm's index allows it)."""

    kind: str = "none"
    k: int = 3
    delta: float = 0.7
    gamma: float = 0.5
    lo: int = 1
    hi: int = 1 << 30

    def next(self, k: int, rewards: list[float], played: list[int], sums: np.ndarray, counts: np.ndarray, t: float) -> int:
        hi = min(self.hi, len(sums))
        if self.kind == "none" or not rewards:
            return k
        eff = float(np.mean(rewards))
        if self.kind == "naive1":
            return max(self.lo, math.floor((1 - self.gamma) * k)) if eff < self.delta else min(hi, math.ceil((1 + self.gamma) * k))
        if self.kind == "naive3":
            eff = float(np.mean([sums[a] / counts[a] if counts[a] else 0 for a in played]))
        if self.kind in ("naive2", "naive3"):
            return max(self.lo, k - 1) if eff < self.delta else min(hi, k + 1)
        if self.kind not in ("kl", "klplus"):
            raise ValueError(f"no scaling {self.kind}")
        k, eff = len(played), float(np.mean([sums[a] / counts[a] if counts[a] else 0 for a in played]))
        if eff <= self.delta:
            return max(min(self.lo, k), k - 1)
        if k >= hi:
            return k
        index = sorted((kl_index(sums[a], counts[a], t, self.kind == "klplus") for a in range(len(sums))), reverse=True)
        b = index[k] if k < len(index) else 0.0
        return min(hi, k + 1) if k / (k + 1) * eff + b / (k + 1) > self.delta else k


def kl_index(total: float, count: float, t: float, plus: bool = False) -> float:
    if count <= 0:
        return 1.0
    log = math.log(max(t / count, 1.0)) if plus else math.log(max(t, 1.0))
    return kl_upper(total / count, count, log / count)


# -- policies ---------------------------------------------------------------------------------


@dataclass
class Policy:
    """State of one run. name: one of POLICIES, with parameter (discount, window,
    epsilon, mixing) and delta where it has them. Ties go to the lower arm.

    With optimistic, sums and counts begin at 1. An _adwin policy keeps a change
    detector for each arm and forgets steps older than the shortest window."""

    name: str
    arms: int
    scaling: Scaling = Scaling()
    reward: str = "score"
    limit: float = 0.5
    parameter: float = 0.9
    delta: float = 0.1
    seed: int = 1
    steps: int = 1000
    optimistic: bool = True
    discount_counts: bool = False
    k: int = 0
    t: float = 1.0
    history: deque = field(default_factory=deque)

    def __post_init__(self):
        self.base, self.adaptive = self.name.removesuffix("_adwin"), self.name.endswith("_adwin")
        if self.base not in POLICIES:
            raise ValueError(f"no policy {self.name}")
        start = 1.0 if self.optimistic else 0.0
        self.k = min(self.scaling.k, self.arms)
        self.sums, self.counts = np.full(self.arms, start), np.full(self.arms, start)
        self.start = start
        self.last = np.zeros(self.arms)
        self.alpha, self.beta = np.ones(self.arms), np.ones(self.arms)
        self.logw = np.zeros(self.arms)
        self.rng = np.random.default_rng(self.seed)
        self.adwin = SharedAdwin(self.arms, self.delta) if self.adaptive else None
        self.recent = [deque() for _ in range(self.arms)]
        self.pulled = 0
        self.p, self.capped = None, np.zeros(self.arms, bool)

    # choosing

    def _top(self, index: np.ndarray, k: int | None = None) -> list[int]:
        return np.argsort(-index, kind="stable")[: self.k if k is None else k].tolist()

    def _ucb(self, factor: float, sums, counts, t: float) -> np.ndarray:
        safe = np.maximum(counts, 1e-300)
        bonus = np.sqrt(factor * math.log(t) / safe) if t >= 1 else np.zeros(self.arms)
        return np.where(counts > 0, sums / safe + np.where(counts > 0, bonus, 0), 0.0)

    def choose(self, hindsight=None) -> list[int]:
        b, k = self.base, self.k
        if b in ("cucb", "mpducb"):
            return self._top(self._ucb(1.5, self.sums, self.counts, self.t))
        if b == "cucbm":
            return self._top(self._ucb(0.5, self.sums, self.counts, self.t))
        if b == "mpswucb":
            return self._top(self._ucb(1.5, *self._windowed(), min(self.t, self.parameter)))
        if b in ("cts", "mpts", "mpdts"):
            return self._top(self.rng.beta(self.alpha, self.beta))
        if b in ("mpots", "mpdots"):
            return self._top(np.maximum(self.rng.beta(self.alpha, self.beta), self.alpha / (self.alpha + self.beta)))
        if b == "impts":
            first = self._top(self.alpha / (self.alpha + self.beta), k - 1)
            draw = self.rng.beta(self.alpha, self.beta)
            draw[first] = -1
            return first + self._top(draw, 1)
        if b in ("mpklucb", "mpklucbplus"):
            plus = b == "mpklucbplus"
            return self._top(np.array([kl_index(s, c, self.t, plus) for s, c in zip(self.sums, self.counts, strict=True)]))
        if b == "mpegreedy":
            mean, out = np.where(self.counts > 0, self.sums / np.maximum(self.counts, 1e-300), 0.0), []
            for _ in range(k):
                left = [a for a in range(self.arms) if a not in out]
                out.append(max(left, key=lambda a: (mean[a], -a)) if self.rng.random() < self.parameter else int(self.rng.choice(left)))
            return out
        if b in ("exp3m", "exp3mg"):
            return self._exp3_choose()
        if b == "random":
            return self.rng.permutation(self.arms)[:k].tolist()
        if b == "sequential":
            out = [(self.pulled + j) % self.arms for j in range(k)]
            self.pulled += k
            return out
        return self._top(np.asarray(hindsight, float) * (-1 if b == "worst" else 1))

    def _exp3_gamma(self) -> float:
        if self.base == "exp3mg":
            return min(0.999, self.parameter)
        k, n, left = self.k, self.arms, max(self.steps - self.t + 1, 1)
        return min(0.999, math.sqrt(n * math.log(max(n / k, 1.0 + 1e-9)) / ((math.e - 1) * k * left)))

    def _exp3_choose(self) -> list[int]:
        k, n = self.k, self.arms
        self.capped = np.zeros(n, bool)
        if k >= n:
            self.p, self.g = np.ones(n), self._exp3_gamma()
            return list(range(n))
        g = self.g = self._exp3_gamma()
        w = np.exp(self.logw - self.logw.max())
        theta = (1 / k - g / n) / (1 - g)
        if w.max() >= theta * w.sum():
            order = np.argsort(-w, kind="stable")
            rest = w.sum()
            for i in range(1, n + 1):
                rest -= w[order[i - 1]]
                if 1 - i * theta <= 0:
                    break
                cap = theta * rest / (1 - i * theta)
                if i == n or cap >= w[order[i]]:
                    self.capped[order[:i]] = True
                    w[order[:i]] = cap
                    break
        self.p = np.clip(k * ((1 - g) * w / w.sum() + g / n), 0, 1)
        return self._round(self.p.copy())

    def _round(self, p: np.ndarray) -> list[int]:
        """Dependent rounding: k arms, each with its probability."""
        while True:
            open_ = np.flatnonzero((p > 1e-5) & (p < 1 - 1e-5))
            if len(open_) < 2:
                return np.argsort(-p, kind="stable")[: self.k].tolist()
            i, j = self.rng.choice(open_, 2, replace=False)
            a, b = min(1 - p[i], p[j]), min(p[i], 1 - p[j])
            if self.rng.random() < b / (a + b):
                p[i], p[j] = p[i] + a, p[j] - a
            else:
                p[i], p[j] = p[i] - b, p[j] + b

    # learning

    def observe(self, played: list[int], values: list[float]) -> list[float]:
        b = self.base
        gains = [REWARDS[self.reward](v, self.last[a], self.limit) for a, v in zip(played, values, strict=True)]
        step = []
        if b in ("mpdts", "mpdots"):
            self.alpha, self.beta = np.maximum(self.alpha * self.parameter, 0.001), np.maximum(self.beta * self.parameter, 0.001)
        if b in ("mpducb", "mpdts", "mpdots") and self.discount_counts:
            self.sums, self.counts = self.sums * self.parameter, self.counts * self.parameter
        for a, v, d in zip(played, values, gains, strict=True):
            self.last[a] = v
            self.sums[a] += d
            self.counts[a] += 1
            own = min(max(d, 0.0), 1.0)
            if b == "cts":
                own = float(self.rng.random() < own)
            self.alpha[a] += own
            self.beta[a] += 1 - own
            step.append((a, d, own))
            if self.adwin:
                self.adwin.add(a, d)
        if b == "mpswucb":
            for a, q in enumerate(self.recent):
                q.extend((self.t, d) for x, d, _ in step if x == a)
                while q and q[0][0] <= self.t - self.parameter:
                    q.popleft()
        self.t = self.parameter * self.t + 1 if b == "mpducb" else self.t + 1
        if self.adwin:
            self.history.append(step)
            self._forget()
        sums, counts, t = self.sums, self.counts, max(self.t, 1.0)
        if b == "mpswucb":
            sums, counts, t = *self._windowed(), min(t, self.parameter)
        self.k = min(self.scaling.next(self.k, gains, played, sums, counts, t), self.arms)
        if b in ("exp3m", "exp3mg"):  # with the number of arms of the next step
            for a, d, _ in step:
                if not self.capped[a]:
                    self.logw[a] += self.k * self.g * d / (self.p[a] * self.arms)
        return gains

    def _windowed(self) -> tuple[np.ndarray, np.ndarray]:
        """What each arm gained in the window, and how often it was played there."""
        return np.array([sum(r for _, r in q) for q in self.recent]) + self.start, np.array([len(q) for q in self.recent]) + self.start

    def _forget(self) -> None:
        """Undo steps older than the shortest window, counted in steps."""
        n = len(self.history)
        keep = min(w + n - (c - self.start) for w, c in zip(self.adwin.sizes(), self.counts, strict=True))
        while len(self.history) > max(keep, 1):
            for a, d, own in self.history.popleft():
                self.sums[a] -= d
                self.counts[a] -= 1
                self.alpha[a] -= own
                self.beta[a] -= 1 - own
        self.t = len(self.history) + 1


POLICIES = ("cucb", "cucbm", "cts", "mpts", "mpots", "impts", "mpklucb", "mpklucbplus", "mpdts", "mpdots", "mpducb", "mpegreedy", "mpswucb", "exp3m", "exp3mg", "dynamic", "worst", "static", "random", "sequential")
ADAPTIVE = tuple(f"{p}_adwin" for p in ("cucb", "mpts", "mpklucb", "exp3m", "dynamic", "static", "random", "sequential"))


def play(policy: Policy, values: np.ndarray) -> list[tuple]:
    """values: steps by arms. (t, arms, gains, gain, k) for each step; what isn't
    chosen isn't looked at, except by the hindsight policies."""
    out = []
    reward = lambda row, old: np.array([REWARDS[policy.reward](v, o, policy.limit) for v, o in zip(row, old, strict=True)])
    total = sum(reward(row, old) for row, old in zip(values, np.vstack([np.zeros(policy.arms), values[:-1]]), strict=True)) if policy.base == "static" else None
    for t, row in enumerate(values):
        seen = total if policy.base == "static" else reward(row, policy.last) if policy.base in ("dynamic", "worst") else None
        k = policy.k
        arms = policy.choose(seen)
        gains = policy.observe(arms, [float(row[a]) for a in arms])
        out.append((t, arms, gains, float(sum(gains)), k))
    return out


RUN = "policy string, rep int, t int, arms array<int>, gains array<double>, gain double, k int"


def run_policies(stream: DataFrame, names: list[str], reps: int = 1, **options) -> DataFrame:
    """stream (t, arm, value): every policy and repetition over it. A group holds
    the whole stream of values, steps by arms, as its state machine must."""
    runs = stream.withColumn("policy", F.explode(F.array(*[F.lit(n) for n in names]))).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        name, rep = frame["policy"].iloc[0], int(frame["rep"].iloc[0])
        values = frame.pivot(index="t", columns="arm", values="value").sort_index().fillna(0.0).to_numpy()
        policy = Policy(name, values.shape[1], seed=1 + rep, steps=len(values), **options)
        out = pd.DataFrame(play(policy, values), columns=["t", "arms", "gains", "gain", "k"])
        return out.assign(policy=name, rep=rep)[["policy", "rep", "t", "arms", "gains", "gain", "k"]]

    return runs.groupBy("policy", "rep").applyInPandas(one, RUN)
