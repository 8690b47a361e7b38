"""Distribution functions that Spark SQL lacks, as series over columns, and the
same in numpy for kernels."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

ERF_TERMS, KOLMOGOROV_TERMS = 150, 1000


def _series(first: Column, terms: int | Column, ratio) -> Column:
    """first * (1 + ratio(1) + ratio(1) ratio(2) + ...)."""
    start = F.struct(first.alias("t"), first.alias("s"))

    def step(acc: Column, n: Column) -> Column:
        t = acc["t"] * ratio(n.cast("double"))
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(terms) if isinstance(terms, int) else terms), start, step, lambda acc: acc["s"])


def erf(x: Column) -> Column:
    """By a series of positive terms; 1 from 6 on, where it differs by 2e-17."""
    a = F.abs(x)
    s = _series(a, ERF_TERMS, lambda n: 2 * a * a / (2 * n + 1))
    return F.signum(x) * F.when(a >= 6, F.lit(1.0)).otherwise(2 / math.sqrt(math.pi) * F.exp(-a * a) * s)


def half_gaussian_cdf(x: Column) -> Column:
    return erf(x / math.sqrt(2))


def kolmogorov(z: Column) -> Column:
    """1 - 2 sum (-1)^(k-1) exp(-2 k^2 z^2) over KOLMOGOROV_TERMS terms: near one
    where two samples differ. z = 0 gives 1, as an even number of terms cancels.
    Terms from number 20 / z on are less than the least double and left out."""
    terms = F.when(z > 0.04, 2 * F.ceil(10 / z)).otherwise(KOLMOGOROV_TERMS).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), terms), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0)) * F.exp(-2.0 * k * k * z * z))
    return 1 - 2 * total


def ks_pvalue(d: Column, n1: Column, n2: Column) -> Column:
    """From a distance and two sizes, with the harmonic size cut to a whole number."""
    whole = F.floor(n1.cast("long") * n2.cast("long") / (n1 + n2))
    return kolmogorov(d * F.sqrt(whole.cast("double")))


def log_gamma_half(dof: Column) -> Column:
    """ln Gamma(dof / 2 + 1) for a whole number dof >= 1."""
    odd = dof % 2 == 1
    start = F.when(odd, F.lit(math.log(math.pi) / 2)).otherwise(F.lit(0.0))
    first = F.when(odd, 1).otherwise(2).cast("long")
    return F.aggregate(F.sequence(first, F.greatest(dof.cast("long"), first), F.lit(2).cast("long")), start, lambda s, j: s + F.log(j / 2.0))


def chi_squared_cdf(x: Column, dof: Column) -> Column:
    """The regularised lower incomplete gamma function of (dof / 2, x / 2). Its
    terms rise up to number x / 2 - dof / 2 and fall from there on; as many are
    added as matter. Twelve standard deviations above the mean it is 1."""
    a, h = dof / 2.0, x / 2.0
    far = h > a + 12 * F.sqrt(a) + 60
    terms = F.when((x <= 0) | far, F.lit(1)).otherwise(F.ceil(F.greatest(h - a, F.lit(0.0)) + 12 * F.sqrt(a + h) + 60).cast("int"))
    s = _series(F.lit(1.0), terms, lambda n: h / (a + n))
    value = F.exp(a * F.log(h) - h - log_gamma_half(dof)) * s
    return F.when(x <= 0, F.lit(0.0)).when(far, F.lit(1.0)).otherwise(F.least(value, F.lit(1.0)))


# -- numpy ------------------------------------------------------------------


def kolmogorov_np(z) -> np.ndarray:
    z = np.atleast_1d(np.asarray(z, float))
    k = np.arange(1, KOLMOGOROV_TERMS + 1)
    sign = np.where(k % 2 == 1, 1.0, -1.0)
    return 1 - 2 * (sign * np.exp(-2.0 * k * k * (z * z)[:, None])).sum(axis=1)


def chi_squared_cdf_np(x: float, dof: int) -> float:
    a, h = dof / 2, x / 2
    if x <= 0:
        return 0.0
    if h > a + 12 * math.sqrt(a) + 60:
        return 1.0
    terms = math.ceil(max(h - a, 0) + 12 * math.sqrt(a + h) + 60)
    s = 1.0 + np.cumprod(h / (a + np.arange(1, terms + 1))).sum()
    return min(1.0, math.exp(a * math.log(h) - h - math.lgamma(a + 1)) * float(s))


KL_EDGE, KL_HALVINGS = 1e-8, 60


def kl_upper(p: float, n: float, bonus: float) -> float:
    """The largest q from p up to 1 - KL_EDGE whose divergence from p is at most
    bonus = ln(t) / n: it grows with q, so the interval is halved."""
    p = max(p, KL_EDGE)
    if p >= 1 or n <= 0:
        return 1.0
    near, far = p, 1 - KL_EDGE
    for _ in range(KL_HALVINGS):
        q = (near + far) / 2
        gap = p * math.log(p / q) + (1 - p) * math.log((1 - p) / (1 - q))
        near, far = (q, far) if gap <= bonus else (near, q)
    return near
