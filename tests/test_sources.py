"""Readers and writers, searches and miners on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import kernels
from strandline.functions.timing import timed
from strandline.operators import dataset, dependence, outliers, report, search
from strandline.sources import matrix


def test_csv(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text("a,b,class\n\n1, 2.5 ,0\n3,4,1\n\n5,6,0\n")
    df = matrix.read_csv_matrix(spark, str(p))
    assert df.columns == ["row_id", "x0", "x1"] and [tuple(r) for r in df.orderBy("row_id").collect()] == [(0, 1.0, 2.5), (1, 3.0, 4.0), (2, 5.0, 6.0)]
    assert [r.is_outlier for r in matrix.read_labels(spark, str(p)).orderBy("row_id").collect()] == [False, True, False]
    assert matrix.read_csv_matrix(spark, str(p), exclude_index=True, drop_class=False).columns == ["row_id", "x0", "x1"]
    assert matrix.read_csv_matrix(spark, str(p), sample=True).count() == 3
    c = matrix.Catalog()
    c.add("m", str(p))
    c.register(spark)
    assert spark.table("m").count() == 3
    with pytest.raises(KeyError):
        c.open(spark, "none")
    matrix.write_matrix(df, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).columns == ["1", "2"]


def test_typed_csv_and_names(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("name,n,a.b\nx,1,0.5\nNULL,2,NULL\n")
    df = matrix.read_typed_csv(spark, str(p), {"n": "int", "a.b": "double"})
    assert [t for _, t in df.dtypes] == ["string", "int", "double"]
    assert [tuple(r) for r in df.orderBy("n").collect()] == [("x", 1, 0.5), (None, 2, None)]
    assert matrix.column_names(spark, str(p)) == ["name", "n", "a.b"]
    with pytest.raises(ValueError):
        matrix.read_typed_csv(spark, str(p), {"m": "int"})
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        matrix.read_typed_csv(spark, str(p), {"name": "int"}).collect()


def test_index_of_a_file(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text("a,b\n" + "".join(f"{i},{i // 3}\n" for i in range(30)))
    index, n = matrix.read_index(spark, str(p), "mwp")
    assert n == 30 and {"rk", "adj", "correction"} <= set(index.columns) and index.count() == 60
    index, n = matrix.read_index(spark, str(p))
    assert dependence.subspace_score(index, n, [0, 1], 0, "ksp", 50).head().score > 0.7
    with pytest.raises(ValueError):
        matrix.read_index(spark, str(p), "none")


def test_timed():
    cpu, wall, found = timed(sum, range(100_000), unit="ms")
    assert found == 4999950000 and 0 <= cpu < 5000 and 0 < wall < 5000
    with pytest.raises(ValueError):
        timed(sum, [], unit="h")


def test_arff(spark, tmp_path):
    p = tmp_path / "m.arff"
    p.write_text("@relation r\n@attribute 'one' real\n@attribute two real\n@attribute outlier {'yes','no'}\n% note\n@data\n1,2,'yes'\n3,4,'no'\n5,6\n")
    assert matrix.arff_names(str(p)) == ["one", "two", "outlier"]
    assert [tuple(r) for r in matrix.read_matrix(spark, str(p)).orderBy("row_id").collect()] == [(0, 1.0, 2.0), (1, 3.0, 4.0)]
    assert [r.is_outlier for r in matrix.read_labels(spark, str(p)).orderBy("row_id").collect()] == [True, False]


def test_log_and_summary(spark, tmp_path):
    steps = spark.createDataFrame([(0, [([0, 1], 0.25)]), (1, [([0, 2, 3], 0.5), ([4, 5], 1.0)])], "step long, subspaces array<struct<dims:array<int>,score:double>>")
    assert [r.line for r in matrix.format_log(steps).orderBy("step").collect()] == ["0,1 : 0.2500", "0,2,3 : 0.5000 ; 4,5 : 1.0000"]
    matrix.write_log(steps.coalesce(1), str(tmp_path / "log"))
    assert sorted(r.line for r in matrix.format_log(matrix.read_log(spark, str(tmp_path / "log"))).collect()) == ["0,1 : 0.2500", "0,2,3 : 0.5000 ; 4,5 : 1.0000"]
    for _ in range(2):
        matrix.append_summary(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "s"), ["a", "b", "c"])
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "s"), header=True).collect()] == [("1", "NULL", "NULL")] * 2


def lof_brute(x, k):
    n = len(x)
    d = np.array([[np.sqrt(((a - b) ** 2).sum()) for b in x] for a in x])
    np.fill_diagonal(d, np.inf)
    kth = np.sort(d, axis=1)[:, k - 1]
    near = [np.flatnonzero(d[i] <= kth[i]) for i in range(n)]
    lrd = [len(o) / sum(max(kth[j], d[i, j]) for j in o) for i, o in enumerate(near)]
    return [np.mean([lrd[j] for j in o]) / lrd[i] for i, o in enumerate(near)]


def test_outliers(spark):
    x = np.random.default_rng(0).random((120, 3))
    x[7] += 5
    assert np.allclose(outliers.lof_np(x, 10, 32), lof_brute(x, 10))
    assert outliers.lof_np(np.ones((5, 2)), 3).tolist() == [1.0] * 5 and outliers.lof_np(np.ones((1, 2)), 3).tolist() == [1.0]
    assert outliers.rs_hash_np(x).argmax() == 7
    wide = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "row_id long, x0 double, x1 double, x2 double")
    for scores in (outliers.full_space_lof(wide, 10), outliers.rs_hash(wide, 20), outliers.stream_miner(wide, 60, 30), outliers.subspace_miner(wide, [[0, 1], [2]], "hash")):
        rows = {r.row_id: r.score for r in scores.collect()}
        assert len(rows) == 120 and max(rows, key=rows.get) == 7
    # windows of the miner: full ones with subspaces, also partial ones without
    full = {r.row_id: r.score for r in outliers.stream_miner(wide, 60, 50, "lof", 5, {-1: [[0, 1, 2]]}).collect()}
    assert len(full) == 110
    own = np.stack([np.r_[outliers.lof_np(x[:60], 5), np.full(50, np.nan)], np.r_[np.full(50, np.nan), outliers.lof_np(x[50:110], 5)]])
    assert np.allclose([full[i] for i in range(110)], np.nanmean(own, axis=0))


def test_searches(spark):
    r = np.random.default_rng(1)
    a = r.random(200)
    x = np.stack([a, a + 0.001 * r.random(200), r.random(200), r.random(200)], axis=1)
    wide = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "row_id long, x0 double, x1 double, x2 double, x3 double")
    greedy = {g.ref: g.dims for g in search.greedy_search(wide, m=20).collect()}
    assert set(greedy) == {0, 1, 2, 3} and 1 in greedy[0] and 0 in greedy[1]
    best = search.levelwise_search(wide, 6, 5, m=20).orderBy("place").collect()
    assert best[0].place == 0 and {0, 1} <= set(best[0].dims) and len(best) <= 5
    assert [b.score for b in best] == sorted((b.score for b in best), reverse=True)


def large_window(spark, n=60_000):
    """Rows out of order, with ties, nulls and NaNs; and the matrix in row order."""
    u = lambda seed: (F.xxhash64("id", F.lit(seed)) % 100_000 / 100_000.0)
    cells = u(1).alias("x0"), (u(1) + u(2) / 3).alias("x1"), F.when(F.col("id") % 7 == 3, None).when(F.col("id") % 7 == 4, float("nan")).otherwise(F.round(u(3), 1)).alias("x2"), u(4).alias("x3")
    wide = spark.range(n, numPartitions=5).select((F.lit(n) - F.col("id")).alias("row_id"), *cells).repartition(6, "x3")
    x = wide.orderBy("row_id").select("x0", "x1", "x2", "x3").toPandas().to_numpy(float)
    return wide, kernels.WindowIndex(x)


def test_greedy_search_of_a_large_window(spark):
    """More rows than any one array of them could hold: as the plain kernels."""
    wide, index = large_window(spark)
    for ref, dims, score in search.greedy_search(wide, m=5).collect():
        want = kernels.greedy_subspace(index, ref, lambda s, r=ref: kernels.deviation(index, s, r, m=5))
        assert (tuple(dims), score) == want
    sets = spark.createDataFrame([([0, 2, 3], 0), ([1, 2], 2)], "dims array<int>, ref int")
    for dims, ref, score in search.scored_subspaces(wide, sets, "deviation", "mwp", m=3).collect():
        assert score == kernels.deviation(index, dims, ref, "mwp", 3)
    assert search.greedy_search(wide.limit(0), m=5).count() == 4


def test_levelwise_search_of_a_large_window(spark):
    """As levels grown one set after the other."""
    wide, index = large_window(spark)
    scored = lambda sets: sorted(((kernels.contrast(index, s, m=5), s) for s in sets), key=lambda x: (-x[0], x[1]))
    level, kept = scored([[i, j] for i in range(4) for j in range(i + 1, 4)])[:5], []
    while len(level[0][1]) < 4:
        known = [s for _, s in level]
        unions = {tuple(sorted({*a, *b})) for a in known for b in known}
        fresh = scored([list(u) for u in unions if len(u) == len(known[0]) + 1 and all([x for x in u if x != y] in known for y in u)])
        if not fresh or fresh[0][0] < level[-1][0]:
            break
        kept += [(score, s) for score, s in level if not any(score < above and set(s) < set(u) for above, u in fresh)]
        level = fresh[:5]
    want = sorted(kept + level, key=lambda x: (-x[0], x[1]))[:5]
    got = search.levelwise_search(wide, 5, 5, m=5).orderBy("place").collect()
    assert [(r.score, r.dims) for r in got] == want


def test_dataset_edges(spark):
    df = spark.createDataFrame([(0, 1.0, None), (1, float("nan"), 2.0), (2, 3.0, 4.0)], "row_id long, x0 double, x1 double")
    assert {r.row_id for r in dataset.to_long(df).collect()} == {2}
    assert [r.n for r in dataset.numbered(spark.createDataFrame([(30,), (10,), (20,)], "k long"), "k", "n").orderBy("k").collect()] == [0, 1, 2]
    assert dataset.numbered(spark.createDataFrame([], "k long"), "k").count() == 0
    with pytest.raises(ValueError):
        dataset.with_kinds(df, {"x0": "z"})
    assert dataset.kinds_of(dataset.with_kinds(df, {"x1": "c"})) == ["n", "c"]
    w = dataset.windows_of(spark.range(10).select(F.col("id").alias("row_id")), 10, 4, 3)
    assert sorted((r.window, r.row_id) for r in w.collect()) == [(i, r) for i in range(3) for r in range(i * 3, i * 3 + 4)]


def test_fit(spark):
    rows = [(k, float(x), 2.0 + 3.0 * x**-0.7) for k in "ab" for x in range(1, 30)]
    for r in report.fit_decay(spark.createDataFrame(rows, "k string, x double, y double"), "k", "x", "y").collect():
        assert abs(r.a - 2) < 0.01 and abs(r.b - 3) < 0.01 and abs(r.c - 0.7) < 0.01
