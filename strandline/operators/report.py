"""Tables of experiment results: reading ids, cleaning, comparing runs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def part_of_id(ident: Column, place: int, sep: str = "-") -> Column:
    """A part of an id; places count from 1, or from -1 at the end. Null where
    there is none."""
    return F.try_element_at(F.split(ident, sep), F.lit(place))


def conditional_part(ident: Column, contains: str, then: int, otherwise: int, sep: str = "-") -> Column:
    return F.when(ident.contains(contains), part_of_id(ident, then, sep)).otherwise(part_of_id(ident, otherwise, sep))


def success_ratio(success: Column, tried: Column) -> Column:
    return F.when(tried > 0, success / tried).otherwise(0.0)


def clean_number(text: Column) -> Column:
    """Without a trailing .0; empty where null."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\.0$", "")


def token_number(text: Column, sep: str = ",") -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.size(F.split(text, sep)))


def classify(text: Column, classes: list[tuple[str, str]], default: str) -> Column:
    """The class of the first needle that the text contains."""
    out = F.lit(default)
    for needle, name in reversed(classes):
        out = F.when(text.contains(needle), name).otherwise(out)
    return out


def relabel(text: Column, names: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(table, text), text)


def group_mean(df: DataFrame, by: list[str], value: str, nonzero: bool = False) -> DataFrame:
    rows = df.where(F.col(value) != 0) if nonzero else df
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"))


def best_row(df: DataFrame, by: list[str], value: str, tie: str) -> DataFrame:
    """The whole row with the largest value of each group, by partial maxima."""
    row = F.max_by(F.struct(*[c for c in df.columns if c not in by]), F.struct(F.col(value), -F.col(tie)))
    return df.groupBy(*by).agg(row.alias("row")).select(*by, "row.*")


def rolling_mean(df: DataFrame, by: list[str], order: str, value: str, rows: int = 100) -> DataFrame:
    return df.withColumn("mean", F.avg(value).over(W.partitionBy(*by).orderBy(order).rowsBetween(-(rows - 1), 0)))


def cumulative_regret(runs: DataFrame, gold: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """runs (by, order, value), gold (order, value): sums of what a run stays
    behind the gold run, step by step."""
    g = gold.select(F.col(order), F.col(value).alias("gold"))
    both = runs.join(g, order)
    return both.withColumn("regret", F.sum(F.col("gold") - F.col(value)).over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def search_frequency(runs: DataFrame, by: list[str], text: str, per: float, sep: str = ",") -> DataFrame:
    """How often each token stands in the lists, per `per` steps."""
    each = runs.where(F.coalesce(F.col(text), F.lit("")) != "").select(*by, F.explode(F.split(text, sep)).alias("token"))
    return each.groupBy(*by, "token").agg((F.count("*") / F.lit(per)).alias("frequency"))


def long_runtimes(wide: DataFrame, key: str) -> DataFrame:
    """A row for each method; milliseconds to seconds."""
    methods = [c for c in wide.columns if c != key]
    return wide.unpivot(key, methods, "method", "ms").select(key, "method", (F.col("ms") / 1000.0).alias("seconds"))


def every_nth(df: DataFrame, order: str, n: int) -> DataFrame:
    """Rows 0, n, 2n, ... of a sequence numbered by `order`."""
    return df.where(F.pmod(F.col(order), F.lit(n)) == 0)


def by_number(df: DataFrame, text: str) -> DataFrame:
    return df.orderBy(F.col(text).cast("double"))


def union_runs(*runs: DataFrame) -> DataFrame:
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out


def fit_decay(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """(by, a, b, c) of y = a + b * x ** -c by least squares: for each c of a
    grid that closes in, a and b have a closed form."""
    import numpy as np

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        xs, ys = frame[x].to_numpy(float), frame[y].to_numpy(float)

        def solve(c):
            m = np.stack([np.ones_like(xs), xs**-c], axis=1)
            ab = np.linalg.lstsq(m, ys, rcond=None)[0]
            return float(((m @ ab - ys) ** 2).sum()), ab

        lo, hi = 0.01, 5.0
        for _ in range(8):
            grid = np.linspace(lo, hi, 41)
            i = int(np.argmin([solve(c)[0] for c in grid]))
            lo, hi = grid[max(i - 1, 0)], grid[min(i + 1, 40)]
        c = (lo + hi) / 2
        ab = solve(c)[1]
        return pd.DataFrame({by: [frame[by].iloc[0]], "a": [ab[0]], "b": [ab[1]], "c": [c]})

    kind = dict(df.dtypes)[by]
    return df.groupBy(by).applyInPandas(one, f"{by} {kind}, a double, b double, c double")
