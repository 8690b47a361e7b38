"""Subspace search over a table: the greedy search by reference column, and the
levelwise search with its relational steps."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns
from ..plans.tables import materialize
from .dataset import dims_of

CHUNK = 1 << 16  # ranks in a row of a table of ranks


TURNED = "dim int, part int, seq int, cells binary"


def _turn(batches):
    """For mapInArrow: rows in order -> each column's cells of these rows."""
    part = TaskContext.get().partitionId()
    for seq, batch in enumerate(batches):
        cells = batch.column("x").flatten()
        d = len(cells) // max(batch.num_rows, 1)
        x = cells.to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, d)
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in ((range(d), pa.int32()), ([part] * d, pa.int32()), ([seq] * d, pa.int32()), ([c.tobytes() for c in x.T], pa.binary()))], ["dim", "part", "seq", "cells"])


RANKS = "dim int, at long, n long, ranks binary, cells binary"


def _rank(valued: bool):
    """For mapInArrow: columns' cells in order -> their ranks by row, in chunks."""

    def chunks(dim: int, cells: list[bytes]):
        x = np.frombuffer(b"".join(cells))
        rank = np.empty(len(x), np.int32)
        rank[np.argsort(x, kind="stable")] = np.arange(len(x), dtype=np.int32)
        for a in range(0, len(x), CHUNK):
            row = [dim], [a], [len(x)], [columns.packed(rank[a : a + CHUNK], len(x))], [x[a : a + CHUNK].tobytes() if valued else None]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["dim", "at", "n", "ranks", "cells"])

    def rank(batches):
        dim, cells = None, []
        for batch in batches:
            for own, block in zip(batch.column("dim").to_pylist(), batch.column("cells"), strict=True):
                if own != dim:
                    if cells:
                        yield from chunks(dim, cells)
                    dim, cells = own, []
                cells.append(block.as_py())
        if cells:
            yield from chunks(dim, cells)

    return rank


def _tasks(wide: DataFrame) -> int:
    """As many as run at once: each gets a copy of all ranks."""
    return max(2, min(200, wide.sparkSession.sparkContext.defaultParallelism))


def ranked_columns(wide: DataFrame, test: str = "ksp") -> DataFrame:
    """The columns' ranks by row, in chunks; with their cells where the test needs
    them. Rows that are equal in a column rank in row order. A column is sorted in
    one task."""
    cells = F.array(*[F.col(c).cast("double") for c in dims_of(wide)]).cast("array<double>")
    turned = wide.select("row_id", cells.alias("x")).orderBy("row_id", "x").select("x").mapInArrow(_turn, TURNED)
    parts = max(1, min(len(dims_of(wide)), _tasks(wide)))
    dealt = turned.repartitionById(parts, F.col("dim") % parts).sortWithinPartitions("dim", "part", "seq").select("dim", "cells")
    return materialize(dealt.mapInArrow(_rank(not columns.walked(test)), RANKS), "ranks")


SCORED = "dims array<int>, ref int, score double"


def _scorer(d: int, mode: str, test: str, m: int, alpha: float, beta: float, seed: int):
    """For mapInArrow: chunks of all columns and sets (dims, ref) -> (dims, ref,
    score). Columns go to the task's memory or files; one is read at a time."""

    def score(batches):
        with tempfile.TemporaryDirectory() as folder:
            index, sets = columns.FiledIndex(folder, 0, d), []
            for batch in batches:
                for row in range(batch.num_rows):
                    dim, at, n, ranks, cells, dims, ref = (batch.column(c)[row] for c in ("dim", "at", "n", "ranks", "cells", "dims", "ref"))
                    if not dim.is_valid:
                        sets.append((dims.as_py(), ref.as_py()))
                        continue
                    index.n = n.as_py()
                    for kind, block in (("ranks", ranks), ("cells", cells)):
                        if block.is_valid:
                            index.put(kind, dim.as_py(), at.as_py(), block.as_py())
            for own, ref in sets:
                if mode == "contrast":
                    ref, got = -1, columns.contrast(index, own, test, m, alpha, beta, seed)
                elif mode == "deviation":
                    got = columns.deviation(index, own, ref, test, m, alpha, beta, seed)
                else:
                    own, got = columns.greedy_subspace(index, ref, test, m, alpha, beta, seed)
                yield pa.RecordBatch.from_arrays([pa.array([list(own)], pa.list_(pa.int32())), pa.array([ref], pa.int32()), pa.array([got], pa.float64())], ["dims", "ref", "score"])

    return score


def _scored(wide: DataFrame, ranked: DataFrame, sets: DataFrame, mode: str, test: str, m: int, alpha: float, beta: float, seed: int) -> DataFrame:
    """Sets are dealt over tasks, each of which gets all columns."""
    tasks = _tasks(wide)
    to = F.col("ref") if mode == "greedy" else F.xxhash64("dims", "ref")
    asked = sets.select("dims", "ref", F.pmod(to, F.lit(tasks)).cast("int").alias("task"))
    told = ranked.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    both = told.unionByName(asked, allowMissingColumns=True).repartitionById(tasks, F.col("task")).drop("task")
    return both.mapInArrow(_scorer(len(dims_of(wide)), mode, test, m, alpha, beta, seed), SCORED)


def scored_subspaces(wide: DataFrame, sets: DataFrame, mode: str = "contrast", test: str = "ksp", m: int = 50, alpha: float = 0.5, beta: float = 0.5, seed: int = 1) -> DataFrame:
    """sets (dims, ref): each with its contrast or deviation, side by side, over
    any number of rows."""
    return _scored(wide, ranked_columns(wide, test), sets, mode, test, m, alpha, beta, seed)


def greedy_search(wide: DataFrame, test: str = "ksp", m: int = 50, alpha: float = 0.5, beta: float = 0.5, seed: int = 1) -> DataFrame:
    """(ref, dims, score): for each column the subspace grown around it. Columns
    are searched side by side; within one the steps follow each other."""
    refs = wide.sparkSession.range(len(dims_of(wide))).select(F.array().cast("array<int>").alias("dims"), F.col("id").cast("int").alias("ref"))
    return scored_subspaces(wide, refs, "greedy", test, m, alpha, beta, seed).select("ref", "dims", "score")


# -- levelwise: sets (dims sorted, score) -----------------------------------------------


def candidate_join(level: DataFrame) -> DataFrame:
    """Unions of two sets that differ in one column each. Both sets lack one of
    the union's columns, so they meet on what they share: an equi-join on each
    set less one column."""
    k = F.size("dims")
    part = level.select("dims", F.explode(F.transform(F.sequence(F.lit(1), k), lambda i: F.concat(F.slice("dims", F.lit(1), i - 1), F.slice("dims", i + 1, k)))).alias("rest"))
    a, b = part.alias("a"), part.alias("b")
    both = a.join(b, (F.col("a.rest") == F.col("b.rest")) & (F.element_at(F.array_except("a.dims", "a.rest"), 1) < F.element_at(F.array_except("b.dims", "b.rest"), 1)))
    return both.select(F.array_sort(F.array_union("a.dims", "b.dims")).alias("dims")).distinct()


def prune_candidates(candidates: DataFrame, level: DataFrame) -> DataFrame:
    """Candidates all of whose subsets with one column less are in the level."""
    k = F.size("dims")
    subsets = candidates.select("dims", F.explode(F.transform(F.sequence(F.lit(1), k), lambda i: F.concat(F.slice("dims", F.lit(1), i - 1), F.slice("dims", i + 1, k)))).alias("rest"))
    known = level.select(F.col("dims").alias("rest"))
    missing = subsets.join(known, "rest", "left_anti").select("dims").distinct()
    return candidates.join(missing, "dims", "left_anti").distinct()


def drop_redundant(level: DataFrame, above: DataFrame) -> DataFrame:
    """Sets without a superset of one more column that scores higher: an equi
    anti-join on the supersets' subsets."""
    k = F.size("dims")
    subsets = above.select(F.col("score").alias("higher"), F.explode(F.transform(F.sequence(F.lit(1), k), lambda i: F.concat(F.slice("dims", F.lit(1), i - 1), F.slice("dims", i + 1, k)))).alias("sub"))
    best = subsets.groupBy("sub").agg(F.max("higher").alias("higher"))
    return level.join(best, (F.col("dims") == F.col("sub")) & (F.col("score") < F.col("higher")), "left_anti")


def top_sets(sets: DataFrame, k: int) -> DataFrame:
    return sets.orderBy(F.col("score").desc(), "dims").limit(k)


def levelwise_search(wide: DataFrame, candidate_cutoff: int = 400, output_cutoff: int = 100, test: str = "ksp", m: int = 50, alpha: float = 0.5, seed: int = 1) -> DataFrame:
    """(place, dims, score): sets of high contrast, grown level by level from
    pairs. A level is at most candidate_cutoff sets; each is scored in one job."""
    spark, d, ranked = wide.sparkSession, len(dims_of(wide)), ranked_columns(wide, test)
    score = lambda sets: materialize(_scored(wide, ranked, sets.withColumn("ref", F.lit(-1)), "contrast", test, m, alpha, 0.5, seed).select("dims", "score"), "level")
    pairs = spark.createDataFrame([([x, y],) for x in range(d) for y in range(x + 1, d)], "dims array<int>")
    level = materialize(top_sets(score(pairs), candidate_cutoff), "level")
    kept, size = [], 2
    while size < d:
        fresh = materialize(prune_candidates(candidate_join(level), level), "level")
        if not fresh.limit(1).head(1):
            break
        scored = score(fresh)
        worst = level.agg(F.min("score")).head()[0]
        if scored.agg(F.max("score")).head()[0] < worst:
            break
        kept.append(drop_redundant(level, scored))
        level, size = materialize(top_sets(scored, candidate_cutoff), "level"), size + 1
    kept.append(level)
    out = kept[0]
    for x in kept[1:]:
        out = out.unionByName(x)
    best = top_sets(out, output_cutoff)
    numbered = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "dims")), ).alias("all"))
    return numbered.select(F.posexplode("all").alias("place", "s")).select("place", "s.dims", (-F.col("s.minus")).alias("score"))


SEARCHERS = {"greedy": greedy_search, "levelwise": levelwise_search}
