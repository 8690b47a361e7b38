"""Running counts and sums in a total order, with no task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import materialize


def running_by(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds place (0, 1, ... within the keys) and inclusive running sums.

    Rows are range-partitioned by keys and order and written once, so a key with
    any part of the rows spreads over as many tasks as it fills. Within a
    partition sums run as usual; a key that goes on in further partitions has
    the totals of those before added. At most two rows for each partition
    describe such keys, and these are broadcast.
    """
    sort = [*[F.col(k) for k in keys], *order]
    rows = materialize(df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("__at", F.monotonically_increasing_id()), "ordered")
    rows = rows.withColumn("__part", F.shiftright("__at", 33).cast("int"))
    totals = rows.groupBy("__part", *keys).agg(F.count("*").alias("__n"), *[F.sum(c).alias(f"__{k}") for k, c in sums.items()])
    before = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(F.col("__part").alias("__p"), *[F.col(k).alias(f"__of_{k}") for k in keys], *[F.sum(c).over(before).alias(f"__before{c}") for c in ("__n", *[f"__{k}" for k in sums])])
    carried = carried.where("__before__n is not null")
    same = F.col("__part") == F.col("__p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    rows = rows.join(F.broadcast(carried), same, "left")
    w = W.partitionBy("__part", *keys).orderBy("__at").rowsBetween(W.unboundedPreceding, 0)
    plus = lambda c: F.coalesce(F.col(f"__before__{c}"), F.lit(0))
    out = rows.withColumns({"place": F.count("*").over(w) - 1 + plus("n"), **{k: F.sum(c).over(w) + plus(k) for k, c in sums.items()}})
    return out.select(*df.columns, "place", *sums)
