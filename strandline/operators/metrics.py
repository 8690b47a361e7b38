"""Quality of rankings: curves, areas, precision and recall. Input: (row_id,
score, y), y 1 for what should rank first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.running import running_by


def _ranked(df: DataFrame) -> DataFrame:
    """tp and fp among the rows up to and with each, by score, ties by row_id."""
    order = [F.col("score").desc(), F.col("row_id").asc()]
    return running_by(df.select("row_id", "score", "y"), [], order, {"tp": F.col("y").cast("long"), "fp": 1 - F.col("y").cast("long")})


def _totals(df: DataFrame) -> tuple[int, int]:
    r = df.agg(F.count("*").alias("n"), F.sum(F.col("y").cast("long")).alias("p")).head()
    return r.n, r.p or 0


def roc_curve(df: DataFrame) -> DataFrame:
    """(place, fpr, tpr) after each row; ties aren't merged."""
    n, p = _totals(df)
    return _ranked(df).select("place", (F.col("fp") / F.lit(n - p)).alias("fpr"), (F.col("tp") / F.lit(p)).alias("tpr"))


def roc_auc(df: DataFrame) -> DataFrame:
    """The share of (negative, positive) pairs in which the positive is first."""
    n, p = _totals(df)
    pairs = F.sum(F.when(F.col("y") == 0, F.col("tp")).otherwise(0))
    return _ranked(df).agg((pairs / F.lit(float(max(p * (n - p), 1)))).alias("roc_auc"))


def _thresholds(df: DataFrame) -> DataFrame:
    per = df.groupBy("score").agg(F.sum(F.col("y").cast("long")).alias("own"), F.count("*").alias("k"))
    return running_by(per, [], [F.col("score").desc()], {"tp": F.col("own"), "at": F.col("k")})


def pr_curve(df: DataFrame) -> DataFrame:
    """(threshold, precision, recall) for each distinct score, rows at or above
    it; first the point (1, 0)."""
    _, p = _totals(df)
    points = _thresholds(df).select(F.col("score").cast("double").alias("threshold"), (F.col("tp") / F.col("at")).alias("precision"), (F.col("tp") / F.lit(p)).alias("recall"))
    first = df.sparkSession.range(1, numPartitions=1).select(F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return points.unionByName(first)


def pr_auc(df: DataFrame) -> DataFrame:
    """Right sums of precision over recall: a threshold adds its own positives'
    part of the recall."""
    _, p = _totals(df)
    return _thresholds(df).agg(F.sum(F.col("own") / F.lit(p) * F.col("tp") / F.col("at")).alias("pr_auc"))


def average_precision(df: DataFrame) -> DataFrame:
    _, p = _totals(df)
    total = F.sum(F.when(F.col("y") == 1, F.col("tp") / (F.col("place") + 1)))
    return _ranked(df).agg((F.coalesce(total, F.lit(0.0)) / F.lit(max(p, 1))).alias("average_precision"))


def precision_recall_at(df: DataFrame, percents: tuple[int, ...] = (1, 2, 5, 10, 20, 30)) -> DataFrame:
    """(percent, recall, precision) of the first floor(n / 100 * percent) rows;
    both 0 where none of them is positive."""
    n, p = _totals(df)
    cut = F.array(*[F.struct(F.lit(k).alias("percent"), F.lit(int(n / 100 * k)).alias("top")) for k in percents])
    # no row is looked at for more than the cuts it lies in
    rows = _ranked(df).where(F.col("place") < int(n / 100 * max(percents))).select("place", "y", F.inline(cut)).where("place < top")
    hits = rows.groupBy("percent", "top").agg(F.sum(F.col("y").cast("long")).alias("tp"))
    all_ = df.sparkSession.range(1, numPartitions=1).select(F.inline(cut)).select(F.col("percent").alias("of"), F.col("top").alias("all"))
    out = all_.join(hits, F.col("of") == F.col("percent"), "left")
    tp = F.coalesce("tp", F.lit(0))
    return out.select(F.col("of").alias("percent"), F.when(tp > 0, tp / F.lit(p)).otherwise(0.0).alias("recall"), F.when(tp > 0, tp / F.col("all")).otherwise(0.0).alias("precision"))


def evaluate(df: DataFrame) -> DataFrame:
    """One row of all measures, as the miners' summary has them."""
    at = precision_recall_at(df).groupBy().pivot("percent", [1, 2, 5, 10, 20, 30]).agg(F.first("precision").alias("p"), F.first("recall").alias("r"))
    at = at.select(*[F.col(f"{k}_{x}").alias(f"{x}{k}") for x in "pr" for k in (1, 2, 5, 10, 20, 30)])
    return roc_auc(df).crossJoin(F.broadcast(pr_auc(df))).crossJoin(F.broadcast(average_precision(df))).crossJoin(F.broadcast(at))  # four rows
