"""Windows of column pairs: statistics, rewards, hindsight policies, scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.draws import draw
from ..functions.special import KL_EDGE, KL_HALVINGS
from .dataset import dims_of, row_count, windows_of


def arm_pairs(d: int) -> list[tuple[int, int]]:
    """Pairs (x, y), y < x; the arm of a pair is x (x - 1) / 2 + y."""
    return [(x, y) for x in range(d) for y in range(x)]


def pair_stream(wide: DataFrame, size: int, step: int, arms: list[int] | None = None, action=F.corr) -> DataFrame:
    """(t, arm, x, y, value) for each hopping window and pair of columns, or for
    some arms only. All pairs of a window come from one aggregation over wide
    rows: nothing is joined and only the columns in question are read."""
    cols = dims_of(wide)
    pairs = arm_pairs(len(cols))
    chosen = range(len(pairs)) if arms is None else arms
    rows = windows_of(wide, row_count(wide), size, step)
    values = rows.groupBy("window").agg(*[action(cols[pairs[a][0]], cols[pairs[a][1]]).alias(f"v{a}") for a in chosen])
    each = F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(pairs[a][0]).alias("x"), F.lit(pairs[a][1]).alias("y"), F.col(f"v{a}").alias("value")) for a in chosen])
    return values.select(F.col("window").alias("t"), F.inline(each))


def replay(cached: DataFrame, t: int) -> DataFrame:
    """One step of a stream whose values were computed before."""
    return cached.where(F.col("t") == t)


# -- rewards: new and old value -> reward -----------------------------------------


def absolute_threshold(new: Column, limit: float) -> Column:
    return F.when(F.abs(new) >= limit, 1.0).otherwise(0.0)


def relative_threshold(new: Column, old: Column, limit: float) -> Column:
    return F.when(F.abs(new - old) > limit, 1.0).otherwise(0.0)


def current_score(new: Column) -> Column:
    return F.abs(new)


def before(value: str = "value") -> Column:
    """An arm's previous value, 0 at first, where all arms are always pulled."""
    return F.coalesce(F.lag(value).over(W.partitionBy("arm").orderBy("t")), F.lit(0.0))


# -- policies that need no state: (t, arm, reward) -> (t, arm, reward) --------------


def _top(gains: DataFrame, k: int, *order: Column) -> DataFrame:
    w = W.partitionBy("t").orderBy(*order)
    return gains.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")


def oracle_dynamic(gains: DataFrame, k: int) -> DataFrame:
    return _top(gains, k, F.col("reward").desc(), F.col("arm"))


def oracle_worst(gains: DataFrame, k: int) -> DataFrame:
    return _top(gains, k, F.col("reward"), F.col("arm"))


def oracle_random(gains: DataFrame, k: int, seed: int = 1) -> DataFrame:
    return _top(gains, k, draw(seed, "t", "arm"), F.col("arm"))


def oracle_static(gains: DataFrame, k: int) -> DataFrame:
    """The k arms that are best in hindsight, always. Sums are rounded so that
    their order doesn't hang on the order of addition."""
    best = gains.groupBy("arm").agg(F.round(F.sum("reward"), 9).alias("s")).orderBy(F.col("s").desc(), "arm").limit(k)
    return gains.join(F.broadcast(best.select("arm")), "arm", "left_semi").select(gains.columns)  # k rows


def oracle_sequential(gains: DataFrame, k: int, n_arms: int) -> DataFrame:
    return gains.where(F.pmod(F.col("arm") - F.col("t") * k, F.lit(n_arms)) < k)


# -- scaling: how many arms to play next ------------------------------------------------


def naive_scaling_1(mean_reward: Column, k: Column, delta: float, gamma: float, lo: int, hi: int) -> Column:
    return F.when(mean_reward < delta, F.greatest(F.lit(lo), F.floor((1 - gamma) * k))).otherwise(F.least(F.lit(hi), F.ceil((1 + gamma) * k))).cast("int")


def naive_scaling_2(mean_reward: Column, k: Column, delta: float, lo: int, hi: int) -> Column:
    """Also of cumulative efficiency, where that is given for the mean reward."""
    return F.when(mean_reward < delta, F.greatest(F.lit(lo), k - 1)).otherwise(F.least(F.lit(hi), k + 1)).cast("int")


def kl_upper_column(p: Column, n: Column, bonus: Column) -> Column:
    """The KL upper confidence index by halving, as functions.special has it, over
    columns."""
    p0 = F.greatest(p, F.lit(KL_EDGE))

    def step(s: Column, _: Column) -> Column:
        q = (s["near"] + s["far"]) / 2
        fits = p0 * F.log(p0 / q) + (1 - p0) * F.log((1 - p0) / (1 - q)) <= bonus
        return F.struct(F.when(fits, q).otherwise(s["near"]).alias("near"), F.when(fits, s["far"]).otherwise(q).alias("far"))

    start = F.struct(p0.alias("near"), F.lit(1 - KL_EDGE).alias("far"))
    value = F.aggregate(F.sequence(F.lit(1), F.lit(KL_HALVINGS)), start, step, lambda s: s["near"])
    return F.when((p0 >= 1) | (n <= 0), F.lit(1.0)).otherwise(value)


def kl_scaling(arms: DataFrame, delta: float, lo: int, hi: int, plus: bool = False) -> DataFrame:
    """arms (round, arm, t, sum, cnt, played): by rounds the next number of arms.
    The efficiency is the mean of what the arms played have gained so far for
    each play. A round in which it is no more than delta plays one arm fewer;
    otherwise one more, if with the next largest index it would stay above."""
    spread = F.log(F.greatest(F.col("t") / F.col("cnt"), F.lit(1.0))) if plus else F.log(F.greatest("t", F.lit(1.0)))
    index = kl_upper_column(F.col("sum") / F.col("cnt"), F.col("cnt"), spread / F.col("cnt"))
    played = F.col("played")
    per = arms.groupBy("round").agg(F.sort_array(F.collect_list(index), asc=False).alias("b"), F.sum(played.cast("int")).alias("k"), F.avg(F.when(played, F.col("sum") / F.col("cnt"))).alias("eff"))
    k, eff = F.col("k"), F.col("eff")
    b = F.coalesce(F.get("b", k.cast("int")), F.lit(0.0))
    grow = k / (k + 1) * eff + b / (k + 1) > delta
    nxt = F.when(eff <= delta, F.greatest(F.least(F.lit(lo), k), k - 1)).when((k < hi) & grow, k + 1).otherwise(k)
    return per.select("round", "k", nxt.cast("int").alias("next_k"))
