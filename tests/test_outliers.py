"""Local outlier factors beyond one task's window."""

import numpy as np

from strandline.operators import outliers


def test_lof_beyond_window(spark, monkeypatch):
    """By blocks as in one window, with ties, copies and more than one subspace."""
    monkeypatch.setattr(outliers, "WINDOW_ROWS", 100)
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(size=(200, 3)), np.round(r.normal(size=(80, 3))), np.ones((15, 3))])
    wide = spark.createDataFrame([(i * 3, *map(float, v)) for i, v in enumerate(x)], "row_id long, x0 double, x1 double, x2 double").repartition(3)
    for sets in (None, [[0, 1], [2, 1, 0]]):
        got = {row.row_id: row.score for row in outliers.subspace_miner(wide, sets, "lof", 10).collect()}
        want = np.mean([outliers.lof_np(x[:, s], 10) for s in sets or [[0, 1, 2]]], axis=0)
        assert len(got) == len(x)
        assert all(abs(got[i * 3] - v) < 1e-9 for i, v in enumerate(want))


def test_searching_miner_and_log(spark):
    from pyspark.sql import functions as F

    r = np.random.default_rng(4)
    x = r.normal(size=(60, 3))
    x[:, 1] = x[:, 0] + 0.01 * r.normal(size=60)
    x[7, 1] += 3
    wide = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "row_id long, x0 double, x1 double, x2 double")
    for preset in outliers.PRESETS:
        search = {} if preset == "full" else {"m": 10}
        got = {row.row_id: row.score for row in outliers.searching_miner(wide, preset, 10, **search).collect()}
        assert len(got) == 60 and (preset == "full" or max(got, key=got.get) == 7)
    labels = wide.select("row_id", (F.col("row_id") == 7).cast("int").alias("y"))
    assert outliers.searching_miner(wide, "greedy", 10, labels, m=10).head().roc_auc == 1.0
    log = spark.range(41).select(F.col("id").alias("step"), F.array(F.struct(F.array(F.lit(1), F.lit(0)).alias("dims"), F.lit(0.5).alias("score"))).alias("subspaces"))
    got = {row.row_id: row.score for row in outliers.logged_miner(wide, log, 20, 20, k=5).collect()}
    want = np.concatenate([outliers.lof_np(x[a : a + 20, :2], 5) for a in (0, 20, 40)])
    assert all(abs(got[i] - v) < 1e-9 for i, v in enumerate(want))
    try:
        outliers.logged_miner(wide, log.limit(40), 20, 20)
    except ValueError:
        return
    raise AssertionError("a log of another length was taken")


def test_workload_runner(spark):
    from strandline.plans import workloads

    r = np.random.default_rng(5)
    rows = spark.createDataFrame([("a", i, *map(float, v)) for i, v in enumerate(r.normal(size=(30, 3)))], "stream string, row_id long, x0 double, x1 double, x2 double")
    out = workloads.run_workload("runtime", rows, m=2, window=20)
    assert {x.run for x in out.select("run").distinct().collect()} == {f"{s.id}-{s.eta}-{s.seed}" for s in workloads.runtime_grid(2, 20)}
    mined = workloads.run_miners(rows.drop("stream"), [{"detector": "hash", "size": 20, "step": 10}, {"detector": "lof", "k": 5, "size": 20, "step": 10}])
    assert mined.count() == 60


def test_logged_workload(spark):
    """Miners over a log of subspaces, scored or measured; other names refuse one."""
    import pytest
    from pyspark.sql import functions as F

    from strandline.plans import workloads

    x = np.random.default_rng(6).normal(size=(40, 2))
    x[11] += 9
    wide = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "row_id long, x0 double, x1 double")
    log = spark.range(21).select(F.col("id").alias("step"), F.array(F.struct(F.array(F.lit(0), F.lit(1)).alias("dims"), F.lit(0.5).alias("score"))).alias("subspaces"))
    settings = [{"detector": "lof", "k": k, "size": 20, "step": 20} for k in (3, 5)]
    assert workloads.run_logged_miners(wide, log, settings).groupBy("run").count().orderBy("run").collect() == [("lof-3-20-20", 40), ("lof-5-20-20", 40)]
    labels = wide.select("row_id", (F.col("row_id") == 11).cast("int").alias("y"))
    assert [r.roc_auc for r in workloads.run_logged_miners(wide, log, settings, labels).collect()] == [1.0, 1.0]
    for name, given in (("logged_miners", None), ("miners", log), ("none", None)):
        with pytest.raises(ValueError):
            workloads.run_workload(name, wide, given)
