"""Grids of searches and miners, as lists of settings, and what runs them."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import evaluate
from ..operators.outliers import logged_miner, stream_miner
from ..streaming.searcher import Search, search_stream

WIDTHS = (1, 2, 5, 10, 20, 50, 100)
ETAS = tuple(round(0.1 * i, 1) for i in range(1, 10))


def searches(m: int = 100, window: int = 1000) -> list[Search]:
    """Each selector once; searching all columns only once a window."""
    base = {"m": m, "window": window, "gamma": 0.9}
    return [Search(**base, policy="all", step=window), Search(**base, policy="none", step=1), *[Search(**base, policy=p, n=1, step=1) for p in ("random", "worst", "mpts")]]


def step_grid(m: int = 100, window: int = 1000) -> list[Search]:
    base = {"m": m, "window": window}
    return [*[Search(**base, policy=p, step=s) for s, p in product(WIDTHS, ("random", "worst", "mpts"))], Search(**base, policy="all", step=window), Search(**base, policy="none", step=1)]


def gold(m: int = 100, window: int = 1000) -> list[Search]:
    return [Search(m=m, window=window, policy="all", step=1)]


def width_grid(m: int = 100, window: int = 1000) -> list[Search]:
    return [Search(m=m, window=window, policy=p, n=n, step=10) for p, n in product(("random", "worst", "mpts"), (1, 2, 5, 10))]


def runtime_grid(m: int = 100, window: int = 1000) -> list[Search]:
    return [Search(m=m, window=window, policy="mpts", n=n, step=100) for n in WIDTHS]


def repeated(grid: list[Search], reps: int = 3) -> list[Search]:
    return [Search(**{**g.__dict__, "seed": g.seed + r}) for g in grid for r in range(reps)]


def scaling_grid(m: int = 100, window: int = 1000, adwin_only: bool = False) -> list[Search]:
    kinds = ("stsadwin",) if adwin_only else ("sts", "stsadwin")
    return [Search(m=m, window=window, policy=p, eta=e, delta=0.1, step=10) for p, e in product(kinds, ETAS)]


def miner_grid() -> list[dict]:
    return [{"detector": "hash", "size": 1000, "step": 100}, *[{"detector": "lof", "k": k, "size": 1000, "step": 100} for k in WIDTHS]]


def repeats(m: int = 100, window: int = 1000, reps: int = 10) -> list[Search]:
    """The searches that draw, under several seeds."""
    return repeated([s for s in searches(m, window) if s.policy in ("random", "mpts")], reps)


def adwin_grid(m: int = 100, window: int = 1000) -> list[Search]:
    return scaling_grid(m, window, adwin_only=True)


WORKLOADS = {
    "searches": searches, "step": step_grid, "gold": gold, "width": width_grid, "runtime": runtime_grid, "repeats": repeats,
    "scaling": scaling_grid, "scaling_adwin": adwin_grid, "miners": miner_grid, "logged_miners": miner_grid,
}


def run_searches(stream: DataFrame, settings: list[Search]) -> DataFrame:
    """stream (stream, row_id, columns): the states of each setting's search, with
    run (its id and seed)."""
    each = [search_stream(stream, how).withColumn("run", F.lit(f"{how.id}-{how.eta}-{how.seed}")) for how in settings]
    return reduce(DataFrame.unionByName, each)


def run_miners(wide: DataFrame, settings: list[dict]) -> DataFrame:
    """(run, row_id, score) of each setting's miner over the full space."""
    each = [stream_miner(wide, **how).withColumn("run", F.lit("-".join(str(v) for v in how.values()))) for how in settings]
    return reduce(DataFrame.unionByName, each)


def run_logged_miners(wide: DataFrame, log: DataFrame, settings: list[dict], labels: DataFrame | None = None) -> DataFrame:
    """(run, row_id, score) of each setting's miner in the subspaces that a log
    (step, subspaces) holds, also one of a search done elsewhere; with labels
    (row_id, y) a row of measures for each run instead."""
    each = []
    for how in settings:
        scored = logged_miner(wide, log, **how)
        if labels is not None:
            scored = evaluate(scored.join(labels, "row_id").select("row_id", "score", "y"))
        each.append(scored.withColumn("run", F.lit("-".join(str(v) for v in how.values()))))
    return reduce(DataFrame.unionByName, each)


def run_workload(name: str, rows: DataFrame, log: DataFrame | None = None, labels: DataFrame | None = None, **options) -> DataFrame:
    """Run a grid by its name: over a stream, or for miners over a matrix."""
    if name not in WORKLOADS:
        raise ValueError(f"no workload {name}")
    if (log is None) == (name == "logged_miners"):
        raise ValueError("logged miners, and no other workload, read a log")
    settings = WORKLOADS[name](**options)
    if name == "logged_miners":
        return run_logged_miners(rows, log, settings, labels)
    return run_miners(rows, settings) if name == "miners" else run_searches(rows, settings)
