"""The numpy kernels against the DataFrame operators, and their statistics."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import columns, kernels, special
from strandline.functions.draws import draw, draw_np
from strandline.operators import dependence, ranks
from strandline.plans import queries as Q
from tests.oracle import SMALL


def test_draws(spark):
    df = spark.range(500).select("id", draw(3, "id", "id * 7").alias("x"))
    got = {r.id: r.x for r in df.collect()}
    i = np.arange(500)
    assert [got[k] for k in i] == draw_np(3, i, i * 7).tolist()


def test_special(spark):
    xs = [0.0, 0.1, 0.5, 1.0, 2.5, 5.0, 8.0, -1.5]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", special.erf(F.col("x")).alias("e"), special.kolmogorov(F.abs("x")).alias("k"), special.chi_squared_cdf(F.abs("x"), F.lit(5)).alias("c"))
    for r in df.collect():
        assert abs(r.e - math.erf(r.x)) < 1e-12
        assert abs(r.k - special.kolmogorov_np(abs(r.x))[0]) < 1e-12
        assert abs(r.c - special.chi_squared_cdf_np(abs(r.x), 5)) < 1e-12
    # 0.95 points of the chi-squared distribution
    for dof, x in ((1, 3.841458820694124), (5, 11.070497693516351), (100, 124.34211340400407)):
        assert abs(special.chi_squared_cdf_np(x, dof) - 0.95) < 1e-9
        assert abs(spark.range(1).select(special.chi_squared_cdf(F.lit(x), F.lit(dof))).head()[0] - 0.95) < 1e-9


def window(spark, frame, d):
    rows = frame.groupBy("row_id").pivot("dim", list(range(d))).agg(F.first("v")).orderBy("row_id").collect()
    return np.array([[r[str(i)] for i in range(d)] for r in rows])


@pytest.mark.parametrize("test", ["ks", "ksp", "mwp"])
def test_numeric_windows(spark, test):
    long = Q.long(spark, SMALL)
    index = ranks.corrected_index(long)
    x = kernels.WindowIndex(window(spark, long, Q.D))
    frame = dependence.subspace_score(index, x.n, [0, 1, 2], 0, test, 6).head().score
    assert abs(frame - kernels.deviation(x, [0, 1, 2], 0, test, 6)) < 1e-9
    frame = dependence.subspace_score(index, x.n, [1, 4], None, test, 6).head().score
    assert abs(frame - kernels.contrast(x, [1, 4], test, 6)) < 1e-9


@pytest.mark.parametrize("n", [1, 2, 3, 64, 65, 66, 129, 3000, 70_000])
def test_columns_in_files(tmp_path, monkeypatch, n):
    """Walks over bits, and tests that read one column at a time."""
    monkeypatch.setattr(columns, "HELD", 100_000)
    r = np.random.default_rng(n)
    x = r.random((n, 5))
    x[:, 1], x[:, 2], x[:, 3] = x[:, 0] + 0.1 * x[:, 1], np.round(4 * x[:, 0]), 0
    plain, filed = kernels.WindowIndex(x), columns.FiledIndex(str(tmp_path), n, 5)
    for j in range(5):
        for a, b in ((n // 3, n), (0, n // 3)):
            filed.put("ranks", j, a, columns.packed(plain.rank[a:b, j], n))
            filed.put("cells", j, a, x[a:b, j].tobytes())
    for test in ("ks", "ksp", "mcdep", *(("mwp", "csp") if n > 3 else ())):
        for dims in ([0, 1], [0, 2, 1], [3, 0], [0, 1, 2, 3, 4]):
            assert columns.contrast(filed, dims, test, 9, 0.5, 0.5, 2) == kernels.contrast(plain, dims, test, 9, seed=2)
            assert columns.deviation(filed, dims, 0, test, 9, 0.3, 0.5, 2) == kernels.deviation(plain, dims, 0, test, 9, 0.3, seed=2)
        want = kernels.greedy_subspace(plain, 1, lambda s, t=test: kernels.deviation(plain, s, 1, t, 9))
        assert columns.greedy_subspace(filed, 1, test, 9, 0.5, 0.5, 1) == want


def test_mixed_windows(spark):
    long = Q.mixed(spark, SMALL)
    index = ranks.corrected_index(long)
    x = kernels.WindowIndex(window(spark, long, 3), "noc")
    for ref in (None, 0, 1, 2):
        frame = dependence.subspace_score(index, x.n, [0, 1, 2], ref, "mcdep", 4, kinds=Q.KINDS).head().score
        own = kernels.contrast(x, [0, 1, 2], "mcdep", 4) if ref is None else kernels.deviation(x, [0, 1, 2], ref, "mcdep", 4)
        assert abs(frame - own) < 1e-9, ref


@pytest.mark.parametrize("test", ["ksp", "mwp"])
def test_statistics(test):
    """Dependent columns score high, independent ones don't."""
    r = np.random.default_rng(1)
    a, b = r.random(1000), r.random(1000)
    line, free = kernels.WindowIndex(np.stack([a, a], axis=1)), kernels.WindowIndex(np.stack([a, b], axis=1))
    assert kernels.contrast(line, [0, 1], test, 300) > 0.7 > kernels.contrast(free, [0, 1], test, 300)
    assert kernels.deviation(line, [0, 1], 0, test, 300) > 0.7 > kernels.deviation(free, [0, 1], 0, test, 300)
    for seed in range(10):
        assert 0 <= kernels.contrast(free, [0, 1], test, 1, seed=seed) <= 1.001


def test_greedy_and_checks():
    r = np.random.default_rng(2)
    a = r.random((400, 1))
    x = kernels.WindowIndex(np.concatenate([a, a + 0.01 * r.random((400, 1)), r.random((400, 3))], axis=1))
    dims, score = kernels.greedy_subspace(x, 0, lambda s: kernels.deviation(x, s, 0, m=40))
    assert 1 in dims and score > 0.9
    with pytest.raises(ValueError):
        kernels.deviation(x, [0], 0)
    for bad in ((0, 0.5, 0.5), (5, 1.0, 0.5), (5, 0.5, 0.0)):
        with pytest.raises(ValueError):
            dependence.estimator("ksp", *bad)
    with pytest.raises(ValueError):
        dependence.estimator("ks")


# Arrays and the ranks and corrections they must have.
TIES = {
    (3, 2, 2, 1, 2): ([0, 2, 2, 2, 4], [0, 24, 24, 24, 24]),
    (1, 1, 0, 1, 1, 6): ([0, 2.5, 2.5, 2.5, 2.5, 5], [0, 60, 60, 60, 60, 60]),
}


@pytest.mark.parametrize("values", list(TIES))
def test_tie_ranks(spark, values):
    long = spark.createDataFrame([(i, 0, float(v)) for i, v in enumerate(values)], "row_id long, dim int, v double")
    rows = ranks.corrected_index(long).orderBy("rk").collect()
    assert [r.adj for r in rows] == TIES[values][0] and [r.correction for r in rows] == TIES[values][1]
    _, _, adj, tie = kernels.WindowIndex(np.array(values, float)[:, None]).ties(0)
    assert adj.tolist() == TIES[values][0] and tie.tolist() == TIES[values][1]


def test_long_walks(spark, monkeypatch):
    """Tests cut into ranges of ranks give what whole ones give."""
    index, n = Q._index(spark, SMALL)
    for test in ("ks", "ksp"):
        whole = {(r.ref, r.other): r.score for r in dependence.deviation_matrix(index, n, test, 3).collect()}
        monkeypatch.setattr(dependence, "LONG", 10)
        cut = {(r.ref, r.other): r.score for r in dependence.deviation_matrix(index, n, test, 3).collect()}
        monkeypatch.undo()
        assert whole.keys() == cut.keys() and all(abs(whole[k] - cut[k]) < 1e-12 for k in whole)


def test_running_by(spark):
    from strandline.plans.running import running_by

    rows = [(k, i, (i * 7) % 5) for k, size in ((None, 3), (0, 400), (1, 1), (2, 90)) for i in range(size)]
    df = spark.createDataFrame(rows, "k int, i int, x int").repartition(5)
    out = running_by(df, ["k"], [F.col("i")], {"s": F.col("x")}).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.place == r.i and r.s == sum((j * 7) % 5 for j in range(r.i + 1))
    assert running_by(df.limit(0), [], [F.col("i")], {"s": F.col("x")}).count() == 0
