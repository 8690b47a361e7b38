"""Monte-Carlo dependence of columns: two-sample tests on slices, contrast and
deviation, and their matrices, as window expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.draws import draw, draw_np
from ..functions.kernels import REF_KEY, slice_size
from ..functions.special import chi_squared_cdf, half_gaussian_cdf, ks_pvalue
from ..plans.running import running_by
from ..plans.tables import materialize
from . import ranks

# A selection is (it, row_id, inside) with any number of key columns; keys name
# those that tell two tests apart.


def check(m: int, alpha: float, beta: float) -> None:
    if m <= 0:
        raise ValueError("m must be positive")
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    if not 0 < beta <= 1:
        raise ValueError("beta must lie above 0 and not above 1")


LONG = 1_000_000  # rows of one test above which its walk spreads over tasks


def _walk(tested: DataFrame, keys: list[str], n: int | None) -> DataFrame:
    """Running counts inside and outside over all reference ranks but the last.
    n: rows of one test; tests of more than LONG rows are cut into ranges of
    ranks, smaller ones are walked one by one, side by side."""
    s = F.col("inside").cast("long")
    rows = tested.where(F.col("rk") < F.col("n") - 1).select(*keys, "rk", "n", s.alias("s"))
    i, size = (F.col("rk") + 1).cast("long"), (F.col("n") - 1).cast("long")
    if n is not None and n > LONG:
        walked = running_by(rows, keys, [F.col("rk")], {"a": F.col("s")})
        sums = rows.groupBy(*keys).agg(F.sum("s").alias("m"))
        return walked.join(sums, keys).select(*keys, "a", i.alias("i"), "m", size.alias("size"))
    w = W.partitionBy(*keys)
    run = w.orderBy("rk").rowsBetween(W.unboundedPreceding, 0)
    return rows.select(*keys, F.sum("s").over(run).alias("a"), i.alias("i"), F.sum("s").over(w).alias("m"), size.alias("size"))


def ks_test(tested: DataFrame, keys: list[str], n: int | None = None) -> DataFrame:
    """tested: keys, rk, n, inside. Distance between the slice and all rows."""
    top = F.max(F.abs(F.col("a") * F.col("size") - F.col("i") * F.col("m")))
    out = _walk(tested, keys, n).groupBy(*keys).agg(top.alias("top"), F.max("m").alias("m"), F.max("size").alias("size"))
    return out.select(*keys, F.when(F.col("m") == 0, F.lit(1.0)).otherwise(F.col("top") / (F.col("m") * F.col("size"))).alias("score"))


def ksp_test(tested: DataFrame, keys: list[str], n: int | None = None) -> DataFrame:
    """One minus the p-value of the distance between inside and outside."""
    top = F.max(F.abs(F.col("a") * (F.col("size") - F.col("m")) - (F.col("i") - F.col("a")) * F.col("m")))
    out = _walk(tested, keys, n).groupBy(*keys).agg(top.alias("top"), F.max("m").alias("m"), F.max("size").alias("size"))
    rest = F.col("size") - F.col("m")
    empty = (F.col("m") == 0) | (rest == 0)
    d = F.col("top") / F.when(empty, F.lit(1)).otherwise(F.col("m") * rest)
    return out.select(*keys, F.when(empty, F.lit(1.0)).otherwise(ks_pvalue(d, F.col("m"), F.when(empty, F.lit(1)).otherwise(rest))).alias("score"))


def csp_test(tested: DataFrame, keys: list[str]) -> DataFrame:
    """tested: keys, v, inside. Chi-squared over the values of the reference."""
    per = tested.groupBy(*keys, "v").agg(F.count("*").alias("t"), F.sum(F.col("inside").cast("long")).alias("o"))
    w = W.partitionBy(*keys)
    per = per.withColumn("n", F.sum("t").over(w)).withColumn("n1", F.sum("o").over(w))
    e1, e2 = F.col("t") * F.col("n1") / F.col("n"), F.col("t") * (F.col("n") - F.col("n1")) / F.col("n")
    o1, o2 = F.col("o"), F.col("t") - F.col("o")
    part = F.when(F.col("n1").between(1, F.col("n") - 1), (o1 - e1) * (o1 - e1) / F.nullif(e1, F.lit(0.0)) + (o2 - e2) * (o2 - e2) / F.nullif(e2, F.lit(0.0)))
    out = per.groupBy(*keys).agg(F.sum(part).alias("x"), F.count("*").alias("c"), F.max("n").alias("n"), F.max("n1").alias("n1"))
    value = chi_squared_cdf(F.coalesce("x", F.lit(0.0)), F.greatest(F.col("c") - 1, F.lit(1)))
    return out.select(*keys, F.when(F.col("c") == 1, F.lit(0.0)).when((F.col("n1") == 0) | (F.col("n1") == F.col("n")), F.lit(1.0)).otherwise(value).alias("score"))


def restrictions(corrected: DataFrame, m: int, beta: float, seed: int) -> DataFrame:
    """(dim, it, a, b): the ranks of the reference column that the Mann-Whitney
    test looks at: about beta of them, cut at tie boundaries, with two values at
    least where the column has two."""
    keys = ("dim", "it")
    bounds = materialize(ranks.boundaries(corrected), "boundaries")
    dims = ranks.with_iterations(corrected.select("dim", "n").distinct(), m)
    free = F.floor(F.col("n") * (1 - beta))
    start = dims.withColumn("cut", F.when(free > 0, draw(seed + 2, "it", REF_KEY) % F.greatest(free, F.lit(1))).otherwise(0).cast("long"))
    a = ranks.safe_cuts(bounds, start.select(*keys, "n", "cut")).select(*keys, "n", F.col("safe").alias("a"))
    to = a.withColumn("cut", F.least(F.col("a") + F.floor(F.col("n") * beta), F.col("n") - 1).cast("long"))
    ab = ranks.safe_cuts(bounds, to.select(*keys, "n", "a", "cut")).select(*keys, "n", "a", F.col("safe").alias("b"))
    # all values between a and b are one where the next boundary after a is b
    ab = ranks.around(bounds, ab, cut="a").withColumnsRenamed({"below": "before", "above": "next"}).drop("upto")
    ab = ranks.around(bounds, ab, cut="b").withColumnRenamed("above", "after")
    one = F.coalesce(F.col("next") >= F.col("b"), F.lit(True))
    left = F.when(one & (F.col("a") > 0), F.col("before")).otherwise(F.col("a"))
    right = F.when(one & (F.col("a") == 0) & (F.col("b") < F.col("n")), F.col("after")).otherwise(F.col("b"))
    return ab.select(*keys, left.alias("a"), right.alias("b"))


def mwp_test(tested: DataFrame, keys: list[str]) -> DataFrame:
    """tested: keys, rk, adj, correction, a, b, inside. The half-Gaussian CDF of
    the tie-corrected Mann-Whitney statistic over ranks a up to b - 1."""
    s = F.col("inside").cast("long")
    rows = tested.where((F.col("rk") >= F.col("a")) & (F.col("rk") < F.col("b")) | (F.col("rk") == F.col("a") - 1))
    own = (F.col("rk") >= F.col("a")).cast("long")
    out = rows.groupBy(*keys).agg(
        F.sum(own * s * F.col("adj") * 2).alias("r2"),
        F.sum(own * s).alias("n1"),
        F.max("a").alias("a"),
        F.max("b").alias("b"),
        F.max(F.when(F.col("rk") == F.col("b") - 1, F.col("correction"))).alias("hi"),
        F.coalesce(F.max(F.when(own == 0, F.col("correction"))), F.lit(0.0)).alias("lo"),
    )
    size = F.col("b") - F.col("a")
    n1, n2 = F.col("n1"), size - F.col("n1")
    u = F.col("r2") / 2 - F.col("a") * n1 - F.floor(n1 * (n1 - 1) / 2)
    fix = (F.col("hi") - F.col("lo")) / F.nullif(size.cast("double") * (size - 1), F.lit(0.0))
    spread = n1 * n2 / 12.0 * (size + 1 - fix)
    z = F.abs(u - n1 * n2 / 2.0) / F.sqrt(spread)
    return out.select(*keys, F.when((n1 == 0) | (n2 == 0), F.lit(1.0)).when(spread <= 0, F.lit(0.0)).otherwise(half_gaussian_cdf(z)).alias("score"))


def test_scores(index: DataFrame, selected: DataFrame, test: str, keys: list[str], m: int, beta: float = 0.5, seed: int = 1, n: int | None = None) -> DataFrame:
    """index: a corrected index (dim, row_id, v, rk, n, adj, correction). selected:
    (dim = the reference column, it, row_id, inside, more keys). One score for
    each of the keys, which hold dim and it."""
    tested = selected.join(index, ["dim", "row_id"])
    if test in ("ks", "ksp"):
        return (ks_test if test == "ks" else ksp_test)(tested, keys, n)
    if test == "csp":
        return csp_test(tested, keys)
    if test == "mwp":
        # a row for each column and iteration
        return mwp_test(tested.join(F.broadcast(restrictions(index, m, beta, seed)), ["dim", "it"]), keys)
    raise ValueError(f"no test {test}")


def mcdep_scores(index: DataFrame, selected: DataFrame, kinds: dict[int, str], keys: list[str], m: int, beta: float = 0.5, seed: int = 1, n: int | None = None) -> DataFrame:
    """Each reference column by the test of its kind: n KSP, o MWP, c CSP."""
    out = None
    for kind, test in (("n", "ksp"), ("o", "mwp"), ("c", "csp")):
        if own := [d for d, k in kinds.items() if k == kind]:
            part = test_scores(index.where(F.col("dim").isin(own)), selected.where(F.col("dim").isin(own)), test, keys, m, beta, seed, n)
            out = part if out is None else out.unionByName(part)
    return out


def _slices(index: DataFrame, size: int, m: int, seed: int, kinds: dict[int, str] | None) -> DataFrame:
    """Slices of every column by its kind."""
    cut = {"n": ranks.numeric_slice, "o": ranks.ordinal_slice, "c": ranks.categorical_slice}
    out = None
    for kind in "noc":
        own = None if not kinds else [d for d, k in kinds.items() if k == kind]
        if (kinds and not own) or (not kinds and kind != "n"):
            continue
        part = cut[kind](index if own is None else index.where(F.col("dim").isin(own)), size, m, seed).select("dim", "row_id", "it", "inside")
        out = part if out is None else out.unionByName(part)
    return out


def _reference(seed: int, dims: list[int]) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in dims]), (draw(seed, "it", REF_KEY) % len(dims) + 1).cast("int"))


def subspace_score(index: DataFrame, n: int, dims: list[int], ref: int | None = None, test: str = "ksp", m: int = 50, alpha: float = 0.5, beta: float = 0.5, seed: int = 1, kinds: dict[int, str] | None = None) -> DataFrame:
    """One row, score: the contrast of a subspace, or with ref the deviation of
    that column. n: rows in the index. Size-one subspaces are rejected."""
    check(m, alpha, beta)
    dims = sorted(dims)
    own = index.where(F.col("dim").isin(dims))
    sliced = _slices(own, slice_size(n, alpha, len(dims)), m, seed, kinds)
    refs = F.lit(ref) if ref is not None else _reference(seed, dims)
    # all slices but the reference column's must hold a row
    selected = sliced.withColumn("ref", refs).groupBy("it", "row_id", F.col("ref").alias("dim")).agg(F.bool_and(F.col("inside") | (F.col("dim") == F.col("ref"))).alias("inside"))
    keys = ["dim", "it"]
    if test == "mcdep":
        scores = mcdep_scores(own, selected, kinds or dict.fromkeys(dims, "n"), keys, m, beta, seed, n)
    else:
        scores = test_scores(own, selected, test, keys, m, beta, seed, n)
    return scores.agg(F.avg("score").alias("score"))


def random_alpha(seed: int, it: str = "it") -> Column:
    """A share of 0.1 to 0.9 for each iteration, in steps of a thousandth."""
    return 0.1 + (draw(seed + 3, it, REF_KEY) % 801) / 1000.0


def subspace_score_alpha(index: DataFrame, n: int, dims: list[int], ref: int | None = None, test: str = "ksp", m: int = 50, seed: int = 1) -> DataFrame:
    """Contrast or deviation with a slice size drawn for each iteration."""
    check(m, 0.5, 0.5)
    dims = sorted(dims)
    own = index.where(F.col("dim").isin(dims))
    r = ranks.with_iterations(own, m).withColumn("size", F.ceil(F.pow(random_alpha(seed), F.lit(1.0 / (len(dims) - 1))) * n).cast("long"))
    at = ranks.slice_start(seed, "it", "dim", F.col("n"), F.col("size"))
    sliced = r.withColumn("inside", (F.col("rk") >= at) & (F.col("rk") < at + F.col("size")))
    refs = F.lit(ref) if ref is not None else _reference(seed, dims)
    selected = sliced.withColumn("ref", refs).groupBy("it", "row_id", F.col("ref").alias("dim")).agg(F.bool_and(F.col("inside") | (F.col("dim") == F.col("ref"))).alias("inside"))
    return test_scores(own, selected, test, ["dim", "it"], m, seed=seed, n=n).agg(F.avg("score").alias("score"))


CHUNK = 8192  # ranks that are walked at once


def _walk_chunk(n: int, size: int, starts: np.ndarray, firsts: np.ndarray | None, last: dict[int, list[int]], frame: pd.DataFrame) -> pd.DataFrame:
    """Rows of one reference column in a range of its ranks, with their ranks in
    all columns: for each other column and iteration how many are inside, and the
    least and greatest of (rows inside so far * n - rows so far * all inside)."""
    ref, chunk = int(frame["ref"].iloc[0]), int(frame["chunk"].iloc[0])
    frame = frame.sort_values("rk")
    ranks_ = np.array(frame["ranks"].tolist(), np.int64)
    step = np.arange(1, len(ranks_) + 1)[:, None]
    out = []
    others = np.arange(ranks_.shape[1])
    for it, start in enumerate(starts):
        use = others[others != ref]
        if firsts is not None:  # the smaller column of a pair, or the larger one
            use = use[(ref < use) == firsts[it]]
        own = ranks_[:, use]
        inside = np.cumsum((own >= start[use]) & (own < start[use] + size), axis=0)
        end = np.array(last[ref])[use]
        m = size - ((end >= start[use]) & (end < start[use] + size))
        walk = inside * (n - 1) - step * m
        out.append(pd.DataFrame({"ref": ref, "other": use, "it": it, "chunk": chunk, "m": m, "c": inside[-1], "lo": walk.min(axis=0), "hi": walk.max(axis=0)}))
    return pd.concat(out)


def _pair_scores(index: DataFrame, n: int, test: str, m: int, size: int, seed: int, refs: list[int] | None = None, contrast: bool = False) -> DataFrame:
    """(ref, other, it, score) of a Kolmogorov-Smirnov test for all ordered pairs
    of columns. A slice is a range of ranks, so a row's ranks in all columns tell
    where it is inside: each row goes once to each reference column, to the range
    its rank is in there, and neither pairs nor iterations are shuffled."""
    wide = index.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("dim", "rk"))).alias("own"))
    wide = materialize(wide.select(F.transform("own", lambda x: x["rk"].cast("long")).alias("ranks")), "ranks")
    # what the last row of each column says: a square of the columns
    ends = wide.where(F.exists("ranks", lambda x: x == n - 1)).select("ranks").collect()
    d = len(ends[0].ranks) if ends else 0
    last = {j: list(r.ranks) for r in ends for j in range(d) if r.ranks[j] == n - 1}
    starts = np.array([[int(draw_np(seed, it, j)) % max(n - size, 1) for j in range(d)] for it in range(m)], np.int64).reshape(m, d)
    firsts = np.array([int(draw_np(seed, it, REF_KEY)) % 2 == 0 for it in range(m)]) if contrast else None
    rows = wide.select("ranks", F.posexplode("ranks").alias("ref", "rk")).where(F.col("rk") < n - 1)
    if refs is not None:
        rows = rows.where(F.col("ref").isin(refs))
    rows = rows.withColumn("chunk", F.floor(F.col("rk") / CHUNK).cast("int"))
    walked = rows.groupBy("ref", "chunk").applyInPandas(lambda f: _walk_chunk(n, size, starts, firsts, last, f), "ref int, other int, it int, chunk int, m long, c long, lo double, hi double")
    before = F.coalesce(F.sum("c").over(W.partitionBy("ref", "other", "it").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shift = before.cast("double") * (n - 1) - F.col("chunk").cast("double") * CHUNK * F.col("m")
    walked = walked.withColumn("top", F.greatest(F.abs(F.col("lo") + shift), F.abs(F.col("hi") + shift)))
    out = walked.groupBy("ref", "other", "it").agg(F.max("top").alias("top"), F.max("m").alias("m"))
    inner, rest = F.col("m"), F.lit(n - 1) - F.col("m")
    if test == "ks":
        score = F.when(inner == 0, F.lit(1.0)).otherwise(F.col("top") / F.when(inner == 0, 1).otherwise(inner * (n - 1)))
    else:
        empty = (inner == 0) | (rest == 0)
        safe = F.when(empty, F.lit(1)).otherwise(rest)
        score = F.when(empty, F.lit(1.0)).otherwise(ks_pvalue(F.col("top") / F.when(empty, F.lit(1)).otherwise(inner * rest), inner, safe))
    return out.select("ref", "other", "it", score.alias("score"))


def deviation_matrix(index: DataFrame, n: int, test: str = "ksp", m: int = 50, alpha: float = 0.5, beta: float = 0.5, seed: int = 1, refs: list[int] | None = None) -> DataFrame:
    """(ref, other, score) for all ordered pairs of columns, or for the rows
    `refs`: those columns alone are then walked."""
    check(m, alpha, beta)
    size = slice_size(n, alpha, 2)
    if test in ("ks", "ksp"):
        scores = _pair_scores(index, n, test, m, size, seed, refs)
    else:
        sliced = ranks.numeric_slice(index, size, m, seed).select(F.col("dim").alias("other"), "row_id", "it", "inside")
        rows = index if refs is None else index.where(F.col("dim").isin(refs))
        selected = rows.select("dim", "row_id").join(sliced, "row_id").where("dim <> other")
        scores = test_scores(rows, selected, test, ["dim", "other", "it"], m, beta, seed, n).withColumnRenamed("dim", "ref")
    return scores.groupBy("ref", "other").agg(F.avg("score").alias("score"))


def contrast_matrix(index: DataFrame, n: int, test: str = "ksp", m: int = 50, alpha: float = 0.5, seed: int = 1, beta: float = 0.5) -> DataFrame:
    """(x, y, score), y < x: in each iteration one of the two is the reference."""
    check(m, alpha, beta)
    size = slice_size(n, alpha, 2)
    if test in ("ks", "ksp"):
        scores = _pair_scores(index, n, test, m, size, seed, contrast=True)
    else:
        sliced = ranks.numeric_slice(index, size, m, seed).select(F.col("dim").alias("other"), "row_id", "it", "inside")
        first = draw(seed, "it", REF_KEY) % 2 == 0  # the smaller column of a pair
        selected = index.select("dim", "row_id").join(sliced, "row_id").where((F.col("dim") != F.col("other")) & (first == (F.col("dim") < F.col("other"))))
        scores = test_scores(index, selected, test, ["dim", "other", "it"], m, beta, seed, n).withColumnRenamed("dim", "ref")
    return scores.groupBy(F.greatest("ref", "other").alias("x"), F.least("ref", "other").alias("y")).agg(F.avg("score").alias("score"))


ESTIMATORS = ("mcdep", "csp", "ksp", "mwp")


def estimator(name: str, m: int = 50, alpha: float = 0.5, beta: float = 0.5) -> dict:
    """Parameters of an estimator by its name."""
    if name not in ESTIMATORS:
        raise ValueError(f"no estimator {name}")
    check(m, alpha, beta)
    return {"test": name, "m": m, "alpha": alpha, "beta": beta}
