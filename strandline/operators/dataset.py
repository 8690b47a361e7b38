"""Numeric matrices as DataFrames: wide (row_id, x0, x1, ...) and long (row_id,
dim, v)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import draw

KINDS = {"n": "numeric", "o": "ordinal", "c": "categorical"}


def dims_of(wide: DataFrame, row_id: str = "row_id") -> list[str]:
    return [c for c in wide.columns if c != row_id]


def array_matrix(df: DataFrame, row_id: str, array: str, d: int) -> DataFrame:
    """The first d elements of an array column as columns x0, x1, ..."""
    return df.select(F.col(row_id).alias("row_id"), *[F.col(array)[i].cast("double").alias(f"x{i}") for i in range(d)])


def to_long(wide: DataFrame) -> DataFrame:
    """Nulls and NaNs have no rank, so their rows are left out as a whole."""
    cols = dims_of(wide)
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c)) for c in cols])
    cells = F.array(*[F.struct(F.lit(i).alias("dim"), F.col(c).cast("double").alias("v")) for i, c in enumerate(cols)])
    return wide.where(whole).select("row_id", F.inline(cells))


def to_wide(long: DataFrame, d: int) -> DataFrame:
    return long.groupBy("row_id").pivot("dim", list(range(d))).agg(F.first("v")).select("row_id", *[F.col(str(i)).alias(f"x{i}") for i in range(d)])


def transpose(wide: DataFrame, n: int) -> DataFrame:
    """Columns as rows, for the first n rows: for small matrices."""
    return to_long(wide).where(F.col("row_id") < n).groupBy("dim").pivot("row_id", list(range(n))).agg(F.first("v")).select("dim", *[F.col(str(i)).alias(f"r{i}") for i in range(n)])


def transpose_long(long: DataFrame) -> DataFrame:
    """Rows as columns and columns as rows, of any size: cells change numbers."""
    return long.select(F.col("dim").cast("long").alias("row_id"), F.col("row_id").alias("dim"), "v")


def take(df: DataFrame, n: int) -> DataFrame:
    return df.where(F.col("row_id") < n)


def drop(df: DataFrame, n: int) -> DataFrame:
    return df.where(F.col("row_id") >= n)


def head(df: DataFrame) -> DataFrame:
    return df.orderBy("row_id").limit(1)


def tail(df: DataFrame) -> DataFrame:
    return drop(df, 1)


def column(wide: DataFrame, i: int) -> DataFrame:
    """Column i; -1 is the last."""
    return wide.select("row_id", F.col(dims_of(wide)[i]).alias("v"))


def sample_rows(df: DataFrame, n: int = 1000, seed: int = 1, at_least: bool = True) -> DataFrame:
    """n rows without replacement, in a seeded order; fewer rows are all kept.
    at_least tells whether a table of exactly n rows is still reordered; either
    way the rows are the same."""
    return df.orderBy(draw(seed, 0, "row_id"), "row_id").limit(n)


def with_kinds(wide: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Note each column's kind in its metadata; n where none is given."""
    if bad := set(kinds.values()) - set(KINDS):
        raise ValueError(f"unknown kinds {bad}")
    return wide.select("row_id", *[F.col(c).alias(c, metadata={"kind": kinds.get(c, "n")}) for c in dims_of(wide)])


def kinds_of(wide: DataFrame) -> list[str]:
    return [wide.schema[c].metadata.get("kind", "n") for c in dims_of(wide)]


def numbered(df: DataFrame, order: str, name: str = "row_id") -> DataFrame:
    """Positions 0, 1, ... in the order of a unique number, without one task that
    sees all rows: a range partition, counts of its parts, and their sums."""
    from ..plans.tables import materialize

    ranged = materialize(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    counts = ranged.groupBy(F.shiftright("__at", 33).alias("p")).count().orderBy("p").collect()
    base, so_far = [], 0
    for r in counts:
        base += [F.lit(r.p), F.lit(so_far)]
        so_far += r["count"]
    offset: Column = F.create_map(*base)[F.shiftright("__at", 33)] if base else F.lit(0)
    return ranged.withColumn(name, (offset + F.col("__at").bitwiseAND((1 << 33) - 1)).cast("long")).drop("__at")


def windows_of(rows: DataFrame, n: Column | int, size: int, step: int, partial: bool = False) -> DataFrame:
    """Rows with each hopping count window they lie in (window 0, 1, ... from
    row window * step on): computed from the row number, so no join. n: rows in
    all. partial: also windows that begin in the rows but end behind them."""
    n = F.lit(n) if isinstance(n, int) else n
    last = F.floor((n - 1) / step) if partial else F.floor((n - size) / step)
    r = F.col("row_id")
    lo = F.greatest(F.lit(0), F.floor((r - size) / step) + 1).cast("long")
    hi = F.least(last, F.floor(r / step)).cast("long")
    return rows.withColumn("window", F.explode(F.when(hi >= lo, F.sequence(lo, hi))))


def row_count(df: DataFrame) -> int:
    return df.count()
