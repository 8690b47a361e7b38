"""Queries against their SQL on the smallest tables."""

import pytest

from strandline.llm.registry import ORACLE_SQL, QUERIES
from tests.oracle import SMALL, assert_same


@pytest.mark.parametrize("name", ["op1_suffix_array_dedup", "op5_minimax_shards", "op6_bm25_decontamination", "op7_suffix_tree_dedup", "op9_minhash_forest"])
def test_sql(spark, name):
    assert_same(QUERIES[name](spark, SMALL), ORACLE_SQL[name])
