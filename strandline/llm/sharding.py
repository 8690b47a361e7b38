"""Contiguous shards whose largest is as small as can be."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import keyed_rows, materialize, n_parts

PROBES = 1024  # capacities tried in one round of the search


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of sizes up to and with each group, within the partition."""
    part, upto = TaskContext.get().partitionId(), 0
    for b in batches:
        sums = upto + np.cumsum(b.column("size").to_numpy(zero_copy_only=False))
        if len(sums):
            upto = int(sums[-1])
        yield pa.record_batch([*b.columns, pa.array(np.full(len(sums), part, np.int32)), pa.array(sums, pa.int64())], names=[*b.schema.names, "part", "upto"])


def _lookup(want: dict[int, tuple[np.ndarray, np.ndarray]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each wanted (probe, sum within a partition) the largest running sum
    that is no larger, as far as this batch has one."""
    for b in batches:
        part, upto = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for p in np.unique(part):
            probe, most = want.get(int(p), (None, None))
            if probe is not None:
                own = upto[part == p]
                at = np.searchsorted(own, most, side="right") - 1
                yield pa.record_batch([pa.array(probe[at >= 0]), pa.array(own[at[at >= 0]])], names=["probe", "upto"])


class PrefixSums:
    """Running sums of ordered groups: the driver holds one number for each
    partition, the rest stays in a table."""

    def __init__(self, groups: DataFrame):
        self.table = groups
        per = groups.groupBy("part").agg(F.sum("size").alias("size"), F.max("size").alias("most")).orderBy("part").collect()
        self.parts = [r.part for r in per]
        self.ends = np.cumsum([r["size"] for r in per]) if per else np.zeros(0, np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64) if per else self.ends
        self.total = int(self.ends[-1]) if per else 0
        self.most = max((r.most for r in per), default=0)

    def largest(self, sums: np.ndarray) -> np.ndarray:
        """The largest running sum that is at most sums[i], for each i."""
        out = np.where(sums >= self.total, self.total, 0)
        todo = np.flatnonzero(sums < self.total)
        if not len(todo):
            return out
        block = np.searchsorted(self.ends, sums[todo], side="right")
        out[todo] = self.starts[block]
        want = {self.parts[b]: (todo[block == b], sums[todo[block == b]] - self.starts[b]) for b in np.unique(block)}
        near = self.table.where(F.col("part").isin(list(want))).select("part", "upto")
        for r in near.mapInArrow(partial(_lookup, want), "probe long, upto long").groupBy("probe").agg(F.max("upto").alias("upto")).collect():
            out[r.probe] = self.starts[np.searchsorted(self.ends, sums[r.probe], side="right")] + r.upto
        return out


def least_capacity(sums: PrefixSums, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity with which greedy filling needs no more than
    `shards` shards, and the running sums at which it cuts.

    Each round tries PROBES capacities between the bounds instead of one in the
    middle, all in the same pass for each shard filled; the bounds close in on
    the smallest feasible one.
    """
    if not sums.total:
        return 0, []
    lo = max(-(-sums.total // shards), sums.most)
    hi = -(-sums.total // shards) + sums.most  # greedy filling always fits in this

    def fill(capacity: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        at, cuts = np.zeros(len(capacity), np.int64), []
        for _ in range(shards - 1):
            at = sums.largest(at + capacity)
            cuts.append(at)
        return at + capacity >= sums.total, cuts

    while True:
        probes = np.unique(np.linspace(lo, hi, min(PROBES, hi - lo + 1)).astype(np.int64))
        fits, cuts = fill(probes)
        first = int(np.argmax(fits)) if fits.any() else len(probes) - 1
        if first == 0 or probes[first] == probes[first - 1] + 1:
            return int(probes[first]), [int(c[first]) for c in cuts]
        lo, hi = int(probes[first - 1]) + 1, int(probes[first])


def minimax_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Put rows into contiguous shards so that the largest is as small as can be.

    The atomic groups are equal texts, in the order of their first row; a
    group's size is the sum of its rows', a row's size its UTF-8 bytes plus 1.
    The capacity is the smallest for which greedy filling gets by with `shards`
    shards; the cuts are those of that filling.

    Returns doc_id, size, text_crc32, law ('bytes'), shard (0 up to shards - 1),
    slot (place in the shard, gapless from 0), grown_shard (null under this
    law). Every row is placed, repeated rows and null ids too: rows go by
    (doc_id, nulls first; text) within a group. A null text is in the group of
    empty texts. An empty table gives none; other columns are ignored.

    The driver holds a number for each partition and each probe, never a group.
    """
    parts = n_parts(docs)
    rows, _ = keyed_rows(docs)
    text = F.coalesce("text", F.lit(""))
    rows = materialize(
        rows.select("rid", "key", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("content")),
        "sizes",
    )
    groups = rows.groupBy("content").agg(F.min("rid").alias("first"), F.sum("size").alias("size"))
    ordered = groups.repartitionByRange(parts, "first").sortWithinPartitions("first")
    groups = materialize(ordered.mapInArrow(_running, "content binary, first long, size long, part int, upto long"), "groups")
    sums = PrefixSums(groups)
    _, cuts = least_capacity(sums, shards)
    start = F.lit(0).cast("long")
    if sums.parts:
        before = F.create_map(*[x for p, s in zip(sums.parts, sums.starts, strict=True) for x in (F.lit(p), F.lit(int(s)))])
        start = before[F.col("part")] + F.col("upto") - F.col("size")
    shard = sum((F.when(start >= c, 1).otherwise(0) for c in cuts if c < sums.total), F.lit(0))
    placed = rows.join(groups.select("content", "first", shard.cast("int").alias("shard")), "content").select("rid", "key", "size", "crc", "first", "shard")
    ranged = placed.repartitionByRange(parts, "first", "rid").sortWithinPartitions("first", "rid")
    # partition and place within it; written, so that both stay what they are
    numbered = materialize(ranged.withColumn("at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("at", 33).cast("int")
    counts = numbered.groupBy(part.alias("part"), "shard").agg(F.count("*").alias("n")).collect()
    slot = F.col("at")
    if counts:
        per = dict.fromkeys(sorted({r.part for r in counts}), 0)
        for r in counts:
            per[r.part] += r.n
        ends = np.cumsum(list(per.values()))
        base = dict(zip(per, (ends - list(per.values())).tolist(), strict=True))
        per_shard = {s: sum(r.n for r in counts if r.shard < s) for s in {r.shard for r in counts}}
        number = F.create_map(*[x for p, b in base.items() for x in (F.lit(p), F.lit(b))])[part] + F.col("at").bitwiseAND((1 << 33) - 1)
        slot = number - F.create_map(*[x for s, b in per_shard.items() for x in (F.lit(s), F.lit(b))])[F.col("shard")]
    return numbered.select(
        F.col("key").alias("doc_id"),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        slot.cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_minimax_shards(spark, sf_dir):
    """All documents in eight shards."""
    return minimax_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), 8)
