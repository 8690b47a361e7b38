"""Connected components over tables of links, without a driver-side graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import frees, materialize

HELD = 1 << 21  # links that a task holds at once


def gathered(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (id, smallest id) that hang together what links (a, b) do: minima
    spread until they no longer change."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(ids))
    while True:
        least = np.minimum(low[x], low[y])
        new = low.copy()
        for to in (x, y, low[x], low[y]):
            np.minimum.at(new, to, least)
        new = new[new]
        if (new == low).all():
            own = low != np.arange(len(ids))
            return ids[own], ids[low[own]]
        low = new


@frees
def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links as stars, HELD of them at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    row = lambda a, b: pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    for batch in batches:
        held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2)))
        if sum(len(x[0]) for x in held) >= HELD:
            held = [gathered(*(np.concatenate(c) for c in zip(*held, strict=True)))]
            if 2 * len(held[0][0]) > HELD:
                yield row(*held.pop())
    if held:
        yield row(*gathered(*(np.concatenate(c) for c in zip(*held, strict=True))))


def _contracted(e: DataFrame) -> DataFrame:
    return materialize(e.select("a", "b").mapInArrow(_contract, "a long, b long"), "links")


def _with_least(e: DataFrame, least: DataFrame) -> DataFrame:
    """Join a node's minimum back to its links. The key is written as its bitwise
    complement on both sides: so neither side comes in the partitioning of the
    aggregate before, and Spark may split a node with very many links."""
    return e.join(least.select(F.bitwise_not("a").alias("of"), "m"), F.bitwise_not(e.a) == F.col("of")).drop("of")


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return _with_least(both, least).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = _with_least(down, least)
    rest = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return rest.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def _all_stars(e: DataFrame) -> bool:
    """Whether every link leads from a node with no other one to a root."""
    nodes = e.select(F.col("a").alias("v"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionAll(e.select(F.col("b").alias("v"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
    per = nodes.groupBy("v").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
    return not per.agg(F.max((F.col("child") + F.col("parent") > 1).cast("int")).alias("odd")).head().odd


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b): long, in any direction, repeats and loops allowed. Returns
    (id, root): every id that has a link to another, and the smallest id it
    reaches. Tasks first turn the links they read into stars; as written files
    are packed into tasks, further passes gather what more of them hold, without
    a shuffle and HELD links at a time. Then large star and small star alternate
    until all links form stars. Every step is written to the shared folder.
    Minima are aggregated before they are joined back, so a node with very many
    links burdens no single task.
    """
    now = edges.where("a <> b")
    for _ in range(3):
        now = _contracted(now)
    while not _all_stars(now):
        now = _contracted(_small_star(_large_star(now)))
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
