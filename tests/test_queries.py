"""Every registered query of the analytics operators against its SQL."""

import numpy as np
import pytest

from strandline.operators.outliers import lof_np
from strandline.plans.queries import ORACLE_SQL, QUERIES
from tests.oracle import SMALL, assert_same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    assert_same(QUERIES[name](spark, SMALL), ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() > 0


def test_searches_see_all_columns(spark):
    """Queries without SQL read the whole vectors."""
    d = spark.read.parquet(f"{SMALL}/embeddings.parquet").selectExpr("max(size(embedding)) AS d").head().d
    assert {r.ref for r in QUERIES["greedy_search"](spark, SMALL).collect()} == set(range(d))
    sets = [r.dims for r in QUERIES["levelwise_search"](spark, SMALL).collect()]
    assert len(sets) == 100 and max(x for s in sets for x in s) >= 8


def test_miner_sees_all_columns(spark):
    """All columns of each window, against plain scores."""
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], float)
    got = {r.row_id: r.score for r in QUERIES["stream_miner_full"](spark, SMALL).collect()}
    # the first 50 rows lie in the first window only
    want = lof_np(x[:100], 10)[:50]
    assert all(abs(got[r.vec_id] - s) < 1e-6 for r, s in zip(rows, want))
