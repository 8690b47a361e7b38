"""Outlier scores: local density, randomised grid sketches, ensembles over
subspaces and over hopping windows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import MODULUS, draw, draw_np
from ..plans.tables import materialize
from .dataset import dims_of, row_count, windows_of

CELLS, HASHES = 10_000, 4  # counters in a sketch, hashes of a cell
WINDOW_ROWS = 50_000  # rows that one density window may hold


def lof_np(x: np.ndarray, k: int, block: int = 512) -> np.ndarray:
    """Local outlier factor of each row among the others: neighbours are all
    rows within the k-th distance, ties included; scores that aren't finite are
    1. Distances are computed in blocks of rows."""
    n = len(x)
    k = min(k, n - 1)
    if k < 1:
        return np.ones(n)

    def distances(a: int) -> np.ndarray:
        d = np.zeros((min(block, n - a), n))
        for column in x.T:
            d += (column[a : a + block, None] - column[None]) ** 2
        np.sqrt(d, out=d)
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        return d

    kth = np.concatenate([np.partition(distances(a), k - 1, axis=1)[:, k - 1] for a in range(0, n, block)])
    near = []
    for a in range(0, n, block):
        d = distances(a)
        for i, row in enumerate(d):
            own = np.flatnonzero(row <= kth[a + i])
            near.append((own, row[own]))
    with np.errstate(all="ignore"):
        density = np.array([len(o) / np.maximum(kth[o], d).sum() for o, d in near])
        out = np.array([(density[o] / density[i]).mean() for i, (o, _) in enumerate(near)])
    return np.where(np.isfinite(out), out, 1.0)


def _lof_group(cols: list[str], sets: list[list[int]], k: int, frame: pd.DataFrame) -> pd.DataFrame:
    if len(frame) > WINDOW_ROWS:
        raise ValueError(f"a density window holds more than {WINDOW_ROWS} rows: score hopping windows instead")
    x = frame[cols].to_numpy(float)
    score = np.mean([lof_np(x[:, s], k) for s in sets], axis=0)
    return pd.DataFrame({"window": frame["window"], "row_id": frame["row_id"], "score": score})


def lof(windows: DataFrame, k: int, subspaces: list[list[int]] | None = None) -> DataFrame:
    """windows: (window, row_id, columns). (window, row_id, score): the factor of
    each row in its window, or its mean over subspaces. Windows are scored side
    by side; each is bounded by WINDOW_ROWS."""
    cols = [c for c in windows.columns if c not in ("window", "row_id")]
    sets = subspaces or [list(range(len(cols)))]
    return windows.groupBy("window").applyInPandas(lambda f: _lof_group(cols, sets, k, f), "window long, row_id long, score double")


def _near_in_block(cols: list[str], sets: list[list[int]], k: int, frame: pd.DataFrame) -> pd.DataFrame:
    """Rows of one block (asks) with those of another that are within the k-th
    distance there, ties included; the k-th of all blocks is no larger."""
    a, b = frame[frame["asks"]], frame[~frame["asks"]]
    xs, ys, left, right = a[cols].to_numpy(float), b[cols].to_numpy(float), a["row_id"].to_numpy(), b["row_id"].to_numpy()
    out = []
    for number, dims in enumerate(sets):
        for at in range(0, len(a), 512):
            own = left[at : at + 512]
            d = np.zeros((len(own), len(b)))
            for i in dims:
                d += (xs[at : at + 512, i, None] - ys[None, :, i]) ** 2
            np.sqrt(d, out=d)
            d[own[:, None] == right[None]] = np.inf
            kth = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if len(b) >= k else np.full((len(own), 1), np.inf)
            row, col = np.nonzero((d <= kth) & (own[:, None] != right[None]))
            out.append(pd.DataFrame({"part": number, "row_id": own[row], "other": right[col], "d": d[row, col]}))
    return pd.concat(out) if out else pd.DataFrame({"part": [], "row_id": [], "other": [], "d": []})


def blocked_lof(wide: DataFrame, k: int, subspaces: list[list[int]] | None = None) -> DataFrame:
    """(row_id, score): what lof gives for the whole table as one window, for any
    number of rows with a row_id of their own. Blocks of rows meet block by
    block; each row's nearest of all blocks are then merged."""
    cols, n = dims_of(wide), row_count(wide)
    sets = subspaces or [list(range(len(cols)))]
    k, blocks = min(k, n - 1), max(1, math.ceil(4 * n / WINDOW_ROWS))
    if k < 1:
        return wide.select("row_id", F.lit(1.0).alias("score"))
    rows = wide.withColumn("own", F.pmod(F.xxhash64("row_id"), F.lit(blocks)).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asks = rows.select("row_id", *cols, F.col("own").alias("i"), each.alias("j"), F.lit(True).alias("asks"))
    told = rows.select("row_id", *cols, each.alias("i"), F.col("own").alias("j"), F.lit(False).alias("asks"))
    near = asks.unionByName(told).groupBy("i", "j").applyInPandas(lambda f: _near_in_block(cols, sets, k, f), "part int, row_id long, other long, d double")
    near = materialize(near, "near")
    w = Window.partitionBy("part", "row_id")
    place = F.row_number().over(w.orderBy("d"))
    kth = near.withColumn("place", place).where(F.col("place") == k).select("part", "row_id", F.col("d").alias("kth"))
    near = materialize(near.join(kth, ["part", "row_id"]).where("d <= kth").drop("kth"), "near")
    reach = near.join(kth.select("part", F.col("row_id").alias("other"), "kth"), ["part", "other"]).withColumn("reach", F.greatest("kth", "d"))
    total = F.sum("reach")
    density = reach.groupBy("part", "row_id").agg(F.when(total == 0, F.lit(math.inf)).otherwise(F.try_divide(F.count("*"), total)).alias("density"))
    density = materialize(density, "density")
    theirs = density.select("part", F.col("row_id").alias("other"), F.col("density").alias("theirs"))
    mean = near.join(theirs, ["part", "other"]).join(density, ["part", "row_id"]).groupBy("part", "row_id").agg(F.avg(F.col("theirs") / F.col("density")).alias("m"))
    finite = F.when(F.isnan("m") | (F.col("m") == math.inf), 1.0).otherwise(F.col("m"))
    return mean.groupBy("row_id").agg(F.avg(finite).alias("score"))


def whole_lof(wide: DataFrame, k: int, subspaces: list[list[int]] | None = None) -> DataFrame:
    """The table as one window: in one task, or beyond WINDOW_ROWS by blocks."""
    if row_count(wide) > WINDOW_ROWS:
        return blocked_lof(wide, k, subspaces)
    return lof(wide.withColumn("window", F.lit(0).cast("long")), k, subspaces).select("row_id", "score")


def full_space_lof(wide: DataFrame, k: int = 10) -> DataFrame:
    return whole_lof(wide, k)


# -- grid sketches ------------------------------------------------------------------------


SAMPLE = 1000  # rows that a sketch counts


def _samples(ids: DataFrame, n: int, reps: int, seed: int) -> DataFrame:
    """(rep, row_id): SAMPLE rows of their own for each repetition. Rows whose
    draw is small are looked at first; should they be too few, all are."""
    each = ids.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("u", draw(seed, "rep", "row_id"))
    for share in (4 * SAMPLE / n, 1.0):
        near = materialize(each.where(F.col("u") < int(min(1.0, share) * MODULUS)), "sample")
        if near.groupBy("rep").count().where(F.col("count") >= SAMPLE).count() == reps:
            break
    first = F.row_number().over(Window.partitionBy("rep").orderBy("u", "row_id"))
    return materialize(near.withColumn("k", first).where(F.col("k") <= SAMPLE).select("rep", "row_id"), "sample")


def rs_hash(wide: DataFrame, reps: int = 1, seed: int = 1, ensemble: bool = True) -> DataFrame:
    """(row_id, score): in each repetition rows fall into the cells of a random
    grid over random columns; four hashes of the cell count the rows of a sample
    of up to SAMPLE, and the score is minus the binary logarithm of a row's least
    count, on average over repetitions. A row outside the sample counts itself.

    Bounds of the columns are those of the repetition's sample; columns that are
    constant there are left out. Counts are at most SAMPLE for each hash and
    repetition and are broadcast; only hashes of a row meet by its number."""
    cols = dims_of(wide)
    n, s = row_count(wide), min(SAMPLE, row_count(wide))
    if n < 5:
        raise ValueError("five rows at least")
    cells = wide.select("row_id", F.inline(F.array(*[F.struct(F.lit(i).alias("dim"), F.col(c).cast("double").alias("v")) for i, c in enumerate(cols)])))
    everyone = n <= SAMPLE
    sampled = wide.select("row_id", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep")) if everyone else _samples(wide.select("row_id"), n, reps, seed)
    seen = cells.join(F.broadcast(sampled), "row_id")
    bounds = seen.groupBy("rep", "dim").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo < hi").collect()
    live: dict[int, dict[int, tuple[float, float]]] = {r: {} for r in range(reps)}
    for b in bounds:
        live[b.rep][b.dim] = b.lo, b.hi
    plan = [(rep, i, f, shift, live[rep][i][0], live[rep][i][1] - live[rep][i][0]) for rep, i, f, shift in grid_plan([sorted(live[r]) for r in range(reps)], s, seed, ensemble)]
    table = F.broadcast(wide.sparkSession.createDataFrame(plan, "rep int, dim int, f double, shift double, lo double, width double"))

    def hashed(rows: DataFrame, on: list[str]) -> DataFrame:
        at = rows.join(table, on).withColumn("cell", F.floor(((F.col("v") - F.col("lo")) / F.col("width") + F.col("shift")) / F.col("f")).cast("long"))
        sums = [(F.sum(draw(seed + 11 + j, "dim", "cell + 1000000")) % CELLS).alias(f"h{j}") for j in range(HASHES)]
        keyed = at.groupBy("rep", "row_id").agg(*sums)
        return keyed.select("rep", "row_id", F.posexplode(F.array(*[F.col(f"h{j}") for j in range(HASHES)])).alias("j", "h"))

    counts = materialize(hashed(seen, ["rep", "dim"]).groupBy("rep", "j", "h").agg(F.count("*").alias("c")), "counts")
    least = hashed(cells, ["dim"]).join(F.broadcast(counts), ["rep", "j", "h"], "left").groupBy("rep", "row_id").agg(F.min(F.coalesce("c", F.lit(0))).alias("c"))
    if not everyone:
        least = least.join(F.broadcast(sampled.withColumn("counted", F.lit(0))), ["rep", "row_id"], "left").withColumn("c", F.col("c") + F.coalesce("counted", F.lit(1)))
    return least.groupBy("row_id").agg(F.avg(-F.log2("c")).alias("score"))


def grid_plan(live: list[list[int]], s: int, seed: int, ensemble: bool) -> list[tuple[int, int, float, float]]:
    """(rep, column, cell width, shift) from the columns of each repetition that
    aren't constant: widths between 1/sqrt(s) and one minus that; an ensemble's
    repetition uses r random columns."""
    out = []
    for rep, columns in enumerate(live):
        lo = 1 / math.sqrt(s)
        f = lo + float(draw_np(seed + 5, rep, 0)) / MODULUS * (1 - 2 * lo)
        own = list(columns)
        if ensemble:
            top = math.log(s) / math.log(max(2, 1 / f))
            r = round(1 + top / 2 + float(draw_np(seed + 6, rep, 0)) / MODULUS * (top - 1 - top / 2))
            own = sorted(own, key=lambda i: (int(draw_np(seed + 7, rep, i)), i))[: max(1, min(r, len(own)))]
        out += [(rep, i, f, float(draw_np(seed + 8, rep, i)) / MODULUS * f) for i in sorted(own)]
    return out


def rs_hash_np(x: np.ndarray, seed: int = 1) -> np.ndarray:
    """One sketch over all columns of a window, in numpy."""
    n = len(x)
    s = min(SAMPLE, n)
    if n < 5:
        return np.zeros(n)
    sampled = np.zeros(n, bool)
    sampled[np.lexsort((np.arange(n), draw_np(seed, 0, np.arange(n))))[:s]] = True
    lo, hi = x[sampled].min(axis=0), x[sampled].max(axis=0)
    live = np.flatnonzero(hi > lo)
    if not len(live):
        return np.zeros(n)
    total = np.zeros((HASHES, n), np.int64)
    for _, i, f, shift in grid_plan([live.tolist()], s, seed, False):
        cell = np.floor(((x[:, i] - lo[i]) / (hi[i] - lo[i]) + shift) / f).astype(np.int64)
        for j in range(HASHES):
            total[j] += draw_np(seed + 11 + j, i, cell + 1_000_000)
    least = np.min([np.bincount(t[sampled], minlength=CELLS)[t] for t in total % CELLS], axis=0)
    return -np.log2(least + ~sampled)


# -- ensembles --------------------------------------------------------------------------------


def distinct_subspaces(sets: DataFrame) -> DataFrame:
    """(key, dims) with each set of columns once, in order."""
    return sets.select(*[c for c in sets.columns if c != "dims"], F.array_sort(F.array_distinct("dims")).alias("dims")).dropDuplicates()


def _score_windows(cols: list[str], sets: dict[int, list[list[int]]], detector: str, k: int, frame: pd.DataFrame) -> pd.DataFrame:
    x = frame[cols].to_numpy(float)
    w = int(frame["window"].iloc[0])
    own = sets.get(w) or sets[-1]
    scores = [lof_np(x[:, s], k) if detector == "lof" else rs_hash_np(x[:, s]) for s in own]
    return pd.DataFrame({"row_id": frame["row_id"], "score": np.mean(scores, axis=0)})


def stream_miner(wide: DataFrame, size: int, step: int, detector: str = "lof", k: int = 10, subspaces: dict[int, list[list[int]]] | None = None, distinct: bool = False) -> DataFrame:
    """(row_id, score): a row's mean score over the hopping windows it lies in.
    subspaces: by window; -1 for windows that have none of their own. Without
    any, windows are scored over all columns, those included that end behind the
    rows."""
    cols = dims_of(wide)
    rows = windows_of(wide, row_count(wide), size, step, partial=subspaces is None)
    sets = subspaces or {-1: [list(range(len(cols)))]}
    if distinct:
        sets = {w: [list(x) for x in dict.fromkeys(tuple(sorted(set(s))) for s in own)] for w, own in sets.items()}
    sets.setdefault(-1, [list(range(len(cols)))])
    scored = rows.groupBy("window").applyInPandas(lambda f: _score_windows(cols, sets, detector, k, f), "row_id long, score double")
    return scored.groupBy("row_id").agg(F.avg("score").alias("score"))


def subspace_miner(wide: DataFrame, subspaces: list[list[int]], detector: str = "lof", k: int = 100) -> DataFrame:
    """(row_id, score): the mean over subspaces, on the whole table as a window."""
    if detector == "lof":
        return whole_lof(wide, k, subspaces)
    n = row_count(wide)
    return stream_miner(wide, n, n, "hash", k, {0: subspaces})


def logged_miner(wide: DataFrame, log: DataFrame, size: int, step: int, detector: str = "lof", k: int = 10) -> DataFrame:
    """(row_id, score) over hopping windows, each scored in the subspaces that a
    search noted at the window's first position. log (step, subspaces): a row for
    each position 0, 1, ... of the window, and no other number of rows. Windows
    and their subspaces meet by the window; neither passes the driver."""
    cols, n = dims_of(wide), row_count(wide)
    if (found := row_count(log)) != n - size + 1:
        raise ValueError(f"a log over {n} rows in windows of {size} has {n - size + 1} rows, this one {found}")
    asked = log.where(F.pmod("step", F.lit(step)) == 0).select((F.col("step") / step).cast("long").alias("window"), F.transform("subspaces", lambda s: F.array_sort(F.array_distinct(s["dims"]))).alias("sets"))

    def score(frame: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        if not len(frame) or not len(sets):
            return pd.DataFrame({"row_id": [], "score": []})
        own = {-1: [list(x) for x in dict.fromkeys(tuple(int(d) for d in x) for x in sets["sets"].iloc[0])]}
        return _score_windows(cols, own, detector, k, frame)

    windows = windows_of(wide, n, size, step).groupBy("window")
    return windows.cogroup(asked.groupBy("window")).applyInPandas(score, "row_id long, score double").groupBy("row_id").agg(F.avg("score").alias("score"))


#: Search and detector of the miners that find their subspaces themselves.
PRESETS = {"greedy": ("greedy", "lof"), "levelwise": ("levelwise", "lof"), "full": (None, "lof")}


def searching_miner(wide: DataFrame, preset: str = "greedy", k: int = 100, labels: DataFrame | None = None, **search) -> DataFrame:
    """(row_id, score): subspaces are searched, then rows scored in each, and the
    mean taken; with labels (row_id, y) one row of measures instead. The driver
    holds the subspaces: one for each column, or as many as a levelwise search
    puts out."""
    from .metrics import evaluate
    from .search import SEARCHERS

    if preset not in PRESETS:
        raise ValueError(f"no miner {preset}")
    how, detector = PRESETS[preset]
    sets = None if how is None else [list(x) for x in dict.fromkeys(tuple(r.dims) for r in SEARCHERS[how](wide, **search).select("dims").collect())]
    scored = full_space_lof(wide, k) if sets is None else subspace_miner(wide, sets, detector, k)
    return scored if labels is None else evaluate(scored.join(labels, "row_id").select("row_id", "score", "y"))
