"""Sliding indexes: states by hand, windows of a table against states, streams."""

import math
import random
import time

import pytest

from strandline.plans import queries as Q
from strandline.streaming.indexes import KINDS, SlidingCorrected, SlidingCounts, SlidingRanks, index_stream, to_stream
from tests.oracle import SMALL

ODD, EVEN = [2, 6, 1, 3, 4, 5, 7], [4, 2, 6, 1, 3, 5]


@pytest.mark.parametrize(
    "values, want",
    [(ODD, [(2, 1), (0, 2), (3, 3), (4, 4), (5, 5), (1, 6), (6, 7)]), (EVEN, [(3, 1), (1, 2), (4, 3), (0, 4), (5, 5), (2, 6)])],
)
def test_ranks_begin(values, want):
    index = SlidingRanks(values)
    assert [index[i] for i in range(len(index))] == want


@pytest.mark.parametrize(
    "values, new, at",
    [(ODD, 1.5, 1), (ODD, 2.5, 1), (ODD, 4.5, 3), (ODD, 0.5, 0), (ODD, 7.5, 6), (EVEN, 3.5, 3), (EVEN, 4.5, 3), (EVEN, 2.5, 2), (EVEN, 0.5, 0), (EVEN, 7.5, 5)],
)
@pytest.mark.parametrize("kind", [SlidingRanks, SlidingCorrected])
def test_insert(kind, values, new, at):
    index = kind(values)
    index.insert(new)
    assert index[at][:2] == (len(values), new) and len(index) == len(values)
    index.refresh()
    assert index[at][:2] == (len(values) - 1, new)
    assert sorted(index[i][0] for i in range(len(index))) == list(range(len(index)))


def test_ties():
    index = SlidingCorrected([3, 2, 2, 1, 2])
    assert [index[i][1:] for i in range(5)] == [(1, 0, 0), (2, 2, 24), (2, 2, 24), (2, 2, 24), (3, 4, 24)]


def test_stale_until_refreshed():
    index = SlidingCorrected([2, 2, 6, 1, 1, 0])
    index.insert(1)
    assert index[0] == (5, 0, 0, 0) and index[4] == (1, 2, 3.5, 12)
    assert [index[i][1] for i in (1, 2, 3)] == [1, 1, 1]
    index.insert(1)
    assert index[4][1] == 1 and index[5] == (2, 6, 5, 12)
    index.insert(6)
    assert index[5] == (8, 6, -1, -1)
    index.refresh()
    assert [index[i][1:3] for i in range(6)] == [(0, 0), (1, 2.5), (1, 2.5), (1, 2.5), (1, 2.5), (6, 5)]


def test_refreshes_between_inserts():
    index = SlidingCorrected([2, 2, 6, 1, 1, 0])
    for v in (2, 2, 6):
        index.insert(v)
    assert index[0] == (5, 0, 0, 0) and index[5] == (8, 6, -1, -1)
    index.refresh()
    assert index[0] == (2, 0, 0, 0) and index[5] == (5, 6, 5, 12)
    for v in (1, 1, 0):
        index.insert(v)
    assert index[0] == (8, 0, -1, -1) and index[5] == (5, 6, 5, 12)
    for v in (10, -1):
        index.insert(v)
    assert index[0] == (10, -1, -1, -1) and index[5] == (9, 10, -1, -1)
    index.refresh()
    assert [index[i] for i in (0, 1, 4, 5)] == [(5, -1, 0, 0), (3, 0, 1, 0), (0, 6, 4, 6), (4, 10, 5, 6)]
    assert [index[i][1:3] for i in (2, 3)] == [(1, 2.5), (1, 2.5)]


def test_counts():
    index = SlidingCounts([2, 0, 2, 1, 2])
    index.insert(2)
    assert index[2] == ([2, 4, 5], 3)
    index.refresh()
    assert index[2] == ([1, 3, 4], 3)
    index = SlidingCounts([3, 2, 2, 1, 2])
    assert index[2] == ([1, 2, 4], 3) and index[3] == ([0], 1)
    index.insert(2)
    assert index[2] == ([1, 2, 4, 5], 4) and 3 not in index and index[3] == ([], 0)
    index.refresh()
    assert index[2] == ([0, 1, 3, 4], 4)


@pytest.mark.parametrize("kind", sorted(KINDS))
def test_state_equals_new_index(kind):
    """After any inserts a refreshed state is the index of the window alone."""
    rng = random.Random(3)
    values = [rng.choice([None, math.nan, -0.0, 0.0, 1.0, 2.5, 7.0]) for _ in range(200)]
    state = to_stream(values[:9], kind)
    for i in range(9, 200):
        state.insert(values[i])
        if i % 7 == 0:
            state.refresh()
            plain = lambda index: [tuple(None if isinstance(x, float) and math.isnan(x) else x for x in r) for r in index.rows()]
            assert plain(state) == plain(KINDS[kind](values[i - 8 : i + 1]))
    with pytest.raises(ValueError):
        KINDS[kind]().insert(1.0)


def _plain(rows):
    return sorted(tuple("-" if x is None or x != x else float(x) if not isinstance(x, str) else x for x in r) for r in rows)


@pytest.mark.parametrize("kind", sorted(KINDS))
def test_table_equals_state(spark, kind):
    rng = random.Random(5)
    cells = [(s, 0, i * 3, rng.choice([None, math.nan, -0.0, 0.0, 1.0, 2.5]), "other") for s, n in (("a", 40), ("b", 7), (None, 20), ("short", 4)) for i in range(n)]
    got = index_stream(spark.createDataFrame(cells, "stream string, dim int, row_id long, v double, window string"), 5, 3, kind)
    want = []
    for s in ("a", "b", None, "short"):
        values = [c[3] for c in cells if c[0] == s]
        for lo in range(0, len(values) - 4, 3):
            want += [(s if s else "-", 0, lo + 4, *r) for r in KINDS[kind](values[lo : lo + 5]).rows()]
    assert _plain(got.collect()) == _plain(want)
    assert index_stream(spark.createDataFrame([], "stream string, dim int, row_id long, v double"), 5, 3, kind).count() == 0
    with pytest.raises(ValueError):
        index_stream(got, 0, 1, kind)


@pytest.mark.parametrize("kind", sorted(KINDS))
def test_stream_equals_table(spark, tmp_path, kind):
    rows = Q._streamed(spark, SMALL).where("stream in ('0', '1')").withColumn("v", Q.F.expr("if(row_id % 11 = 0, null, v)"))
    want = _plain(index_stream(rows, 8, 3, kind).collect())
    cut = rows.agg(Q.F.expr("percentile(row_id, 0.5)")).head()[0]
    for i, cond in enumerate([f"row_id <= {cut}", f"row_id > {cut}"]):
        rows.where(cond).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1 if i == 0 else 0)
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = index_stream(source, 8, 3, kind).writeStream.format("memory").queryName(f"indexed_{kind}").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert _plain(spark.sql(f"select * from indexed_{kind}").collect()) == want and want
