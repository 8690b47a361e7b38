"""Order structures of columns, and random slices through them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.draws import MODULUS, draw
from ..plans.running import running_by
from ..plans.tables import materialize


BINS = 4096  # ranges of draws that are counted


def rank_index(long: DataFrame, keys: tuple[str, ...] = ("dim",)) -> DataFrame:
    """Ordinal ranks 0, 1, ...; ties go by row_id. Adds rk and n. By column alone
    a group is the whole table, so ranks come from a range partition; keys that
    hold a window make small groups, which are ranked one by one."""
    if keys == ("dim",):
        ranked = running_by(long, ["dim"], [F.col("v"), F.col("row_id")], {}).withColumnRenamed("place", "rk")
        return ranked.join(F.broadcast(long.groupBy("dim").agg(F.count("*").alias("n"))), "dim")  # a row for each column
    w = W.partitionBy(*keys)
    return long.withColumn("rk", F.row_number().over(w.orderBy("v", "row_id")) - 1).withColumn("n", F.count("*").over(w))


def _cubed(t: Column) -> Column:
    """t^3 - t, as a double: a whole number would overflow from two million ties on."""
    d = t.cast("double")
    return d * d * d - d


def corrected_index(long: DataFrame, keys: tuple[str, ...] = ("dim",)) -> DataFrame:
    """Adds rk, n, adj (rank averaged over ties, from 0), ties (rows of the same
    value) and correction (the sum of t^3 - t over tie groups up to its own)."""
    if keys == ("dim",):
        t = F.col("ties")
        values = running_by(long.groupBy("dim", "v").agg(F.count("*").alias("ties")), ["dim"], [F.col("v")], {"upto": t, "correction": _cubed(t)})
        values = values.select("dim", "v", "ties", (F.col("upto") - t + (t - 1) / 2).alias("adj"), "correction")
        return rank_index(long, keys).join(values, ["dim", "v"])
    w, same = W.partitionBy(*keys), W.partitionBy(*keys, "v")
    out = rank_index(long, keys).withColumn("ties", F.count("*").over(same))
    out = out.withColumn("adj", F.rank().over(w.orderBy("v")) - 1 + (F.col("ties") - 1) / 2)
    first = F.row_number().over(same.orderBy("row_id")) == 1
    out = out.withColumn("own", F.when(first, _cubed(F.col("ties"))).otherwise(0.0))
    upto = F.sum("own").over(w.orderBy("v").rangeBetween(W.unboundedPreceding, W.currentRow))
    return out.withColumn("correction", upto).drop("own")


def count_index(long: DataFrame, keys: tuple[str, ...] = ("dim",)) -> DataFrame:
    """Of each value its positions in order, and how many."""
    return long.groupBy(*keys, "v").agg(F.array_sort(F.collect_list("row_id")).alias("positions"), F.count("*").alias("n"))


def boundaries(ranked: DataFrame, keys: tuple[str, ...] = ("dim",)) -> DataFrame:
    """Ranks at which a new value begins, with 0 and n: places for safe cuts. A
    corrected index has them in its rows, without a shuffle."""
    if "ties" in ranked.columns:
        inner = ranked.where(F.col("rk") == F.col("adj") - (F.col("ties") - 1) / 2).select(*keys, F.col("rk").alias("b"))
    else:
        inner = ranked.groupBy(*keys, "v").agg(F.min("rk").alias("b")).select(*keys, "b")
    return inner.unionByName(ranked.groupBy(*keys).agg(F.max("n").alias("b")))


def around(bounds: DataFrame, cuts: DataFrame, keys: tuple[str, ...] = ("dim",), cut: str = "cut") -> DataFrame:
    """Adds to each cut the boundaries (keys, b) around it: below, upto (may equal the cut),
    above (null where there is none). cuts are few, some for each column and
    iteration, and are broadcast as one sorted array for each column; boundaries
    are aggregated by the gap between cuts in which they lie, before any shuffle."""
    cuts = materialize(cuts, "cuts")  # read twice, and often made from other cuts
    each = cuts.groupBy(*keys).agg(F.array_sort(F.collect_set(F.col(cut).cast("long"))).alias("cuts"))
    b = F.col("b")
    lying = bounds.join(F.broadcast(each), list(keys)).withColumn("gap", F.size(F.filter("cuts", lambda c: c < b)))
    to = F.get("cuts", F.col("gap"))  # the cut at the gap's upper end
    gaps = lying.groupBy(*keys, "gap").agg(F.max("b").alias("hi"), F.max(F.when(to.isNull() | (b < to), b)).alias("inner"), F.min("b").alias("lo"))
    place = each.select(*keys, F.posexplode("cuts").alias("at", "__cut")).join(F.broadcast(gaps), list(keys))
    before, own = F.col("gap") < F.col("at"), F.col("gap") == F.col("at")
    found = place.groupBy(*keys, "__cut").agg(
        F.max(F.when(before, F.col("hi")).when(own, F.col("inner"))).alias("below"),
        F.max(F.when(before | own, F.col("hi"))).alias("upto"),
        F.min(F.when(F.col("gap") > F.col("at"), F.col("lo"))).alias("above"),
    )
    of = found.select(*[F.col(k).alias(f"__{k}") for k in keys], "__cut", "below", "upto", "above")
    same = F.col(cut).cast("long") == F.col("__cut")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return cuts.join(F.broadcast(of), same).drop("__cut", *[f"__{k}" for k in keys])


def safe_cuts(bounds: DataFrame, cuts: DataFrame, keys: tuple[str, ...] = ("dim",), cut: str = "cut") -> DataFrame:
    """Move each cut (0 to n) to the nearest tie boundary (keys, b), of two as near
    to the right one."""
    at = F.col(cut)
    right = F.when(F.col("upto") == at, at).otherwise(F.col("above"))
    # a cut behind the last boundary has no right one
    to = F.when(right.isNull() | (at - F.col("upto") < right - at), F.col("upto")).otherwise(right)
    return around(bounds, cuts, keys, cut).withColumn("safe", to).drop("below", "upto", "above")


def slice_start(seed: int, it: Column | str, dim: str, n: Column, size: Column) -> Column:
    """The first rank of a slice: 0 up to n - size - 1, as the reference draws."""
    return draw(seed, it, dim) % F.greatest(n - size, F.lit(1))


def with_iterations(df: DataFrame, m: int) -> DataFrame:
    return df.withColumn("it", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))


def numeric_slice(ranked: DataFrame, size: int, m: int, seed: int = 1) -> DataFrame:
    """For each iteration and column a run of `size` ranks; adds it, inside."""
    r = with_iterations(ranked, m)
    at = slice_start(seed, "it", "dim", F.col("n"), F.lit(size))
    return r.withColumn("inside", (F.col("rk") >= at) & (F.col("rk") < at + size))


def _sized(rows: DataFrame, core: Column, size: int, seed: int) -> DataFrame:
    """Exactly `size` rows of each iteration and column: those of the core first,
    otherwise by chance. The last row that still fits is found by counts of draws
    in BINS ranges and a look at the rows of one range; nothing is sorted whole."""
    turn = F.struct(F.when(core, 0).otherwise(1).alias("late"), draw(seed + 1, "it", "row_id").alias("u"), F.col("row_id").alias("r"))
    rows = rows.withColumn("turn", turn)
    bin_ = F.floor(F.col("turn.u") * BINS / MODULUS).cast("int")
    per = rows.groupBy("dim", "it", F.col("turn.late").alias("late"), bin_.alias("bin")).agg(F.count("*").alias("n_bin"))
    upto = F.sum("n_bin").over(W.partitionBy("dim", "it").orderBy("late", "bin"))
    per = per.withColumn("upto", upto).where(F.col("upto") - F.col("n_bin") < size)
    edge = per.groupBy("dim", "it").agg(F.max(F.struct("late", "bin", (F.col("upto") - F.col("n_bin")).alias("before"))).alias("e"))
    edge = edge.select(F.col("dim").alias("__dim"), F.col("it").alias("__it"), "e")  # a row for each column and iteration
    of = F.col("dim").eqNullSafe(F.col("__dim")) & (F.col("it") == F.col("__it"))
    at = rows.join(F.broadcast(edge), of & (F.col("turn.late") == F.col("e.late")) & (bin_ == F.col("e.bin")))
    at = at.withColumn("nth", F.row_number().over(W.partitionBy("dim", "it").orderBy("turn")) + F.col("e.before"))
    cut = at.where(F.col("nth") <= size).groupBy("dim", "it").agg(F.max("turn").alias("last")).select(F.col("dim").alias("__dim"), F.col("it").alias("__it"), "last")
    return rows.join(F.broadcast(cut), of, "left").withColumn("inside", F.coalesce(F.col("turn") <= F.col("last"), F.lit(False))).drop("turn", "last", "__dim", "__it")


def ordinal_slice(ranked: DataFrame, size: int, m: int, seed: int = 1) -> DataFrame:
    """A run of ranks cut at tie boundaries, then brought to `size` by releasing
    rows of it or adding others at random."""
    bounds = materialize(boundaries(ranked), "boundaries")
    dims = with_iterations(ranked.select("dim", "n").distinct(), m)
    start = dims.withColumn("cut", slice_start(seed, "it", "dim", F.col("n"), F.lit(size)).cast("long"))
    a = safe_cuts(bounds, start.select("dim", "it", "n", "cut")).select("dim", "it", "n", F.col("safe").alias("a"))
    b = a.withColumn("cut", F.least(F.col("a") + size, F.col("n") - 1))
    b = safe_cuts(bounds, b.select("dim", "it", "a", "cut")).select("dim", "it", "a", F.col("safe").alias("b"))
    rows = with_iterations(ranked, m).join(F.broadcast(b), ["dim", "it"])  # a row for each column and iteration
    return _sized(rows, (F.col("rk") >= F.col("a")) & (F.col("rk") < F.col("b")), size, seed).drop("a", "b")


def category_ranks(long: DataFrame, m: int, seed: int) -> DataFrame:
    """Categories of each column in a random order for each iteration."""
    values = long.select("dim", "v").distinct()
    values = values.withColumn("code", F.row_number().over(W.partitionBy("dim").orderBy("v")) - 1)
    values = with_iterations(values.withColumn("n_cat", F.count("*").over(W.partitionBy("dim"))), m)
    return values.withColumn("turn", F.row_number().over(W.partitionBy("dim", "it").orderBy(draw(seed, "it", "code"), "code")))


def categorical_slice(ranked: DataFrame, size: int, m: int, seed: int = 1) -> DataFrame:
    """Random categories, as many as the slice's share of them but one at least
    and all but one at most, then brought to `size` rows."""
    n = ranked.select("dim", "n").distinct()
    c = category_ranks(ranked, m, seed).join(n, "dim")
    k = F.least(F.greatest(F.floor(F.col("n_cat") * size / F.col("n")), F.lit(1)), F.col("n_cat") - 1)
    chosen = c.select("dim", "v", "it", (F.col("turn") <= k).alias("core"))
    return _sized(ranked.join(chosen, ["dim", "v"]), F.col("core"), size, seed).drop("core")


def category_restriction(ranked: DataFrame, size: int, m: int, seed: int = 1) -> DataFrame:
    """(dim, it, v) of random categories, two at least."""
    c = category_ranks(ranked, m, seed).join(ranked.select("dim", "n").distinct(), "dim")
    k = F.least(F.greatest(F.floor(F.col("n_cat") * size / F.col("n")), F.lit(2)), F.col("n_cat"))
    return c.where(F.col("turn") <= k).select("dim", "it", "v")


def uniform_slice(ranked: DataFrame, size: int, m: int, seed: int = 1) -> DataFrame:
    """A run of ranks that may wrap around, so that every row is as likely. It
    serves every kind of column: ties and categories stand together by rank."""
    r = with_iterations(ranked, m)
    return r.withColumn("inside", F.pmod(F.col("rk") - draw(seed, "it", "dim") % F.col("n"), F.col("n")) < size)


def subspace_uniform_slice(ranked: DataFrame, dims: list[int], ref: int, size: int, m: int, seed: int = 1) -> DataFrame:
    """(it, row_id, inside): in the uniform slices of all dims but the reference one."""
    return subspace_slice(uniform_slice(ranked.where(F.col("dim").isin(dims)), size, m, seed), dims, ref)


def subspace_slice(sliced: DataFrame, dims: list[int], ref: int) -> DataFrame:
    """(it, row_id, inside): in the slices of all dims but the reference one."""
    others = sliced.where(F.col("dim").isin([d for d in dims if d != ref]))
    return others.groupBy("it", "row_id").agg(F.bool_and("inside").alias("inside"))


def closest_coprime(pairs: DataFrame, reach: int = 64) -> DataFrame:
    """pairs (a, b): the number nearest to a that has no divisor with b in
    common, of two as near the larger; both at least 1."""

    def gcd(x: Column, y: Column) -> Column:
        state = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))
        done = F.aggregate(F.sequence(F.lit(1), F.lit(100)), state, lambda s, _: F.struct(F.when(s["y"] == 0, s["x"]).otherwise(s["y"]).alias("x"), F.when(s["y"] == 0, F.lit(0).cast("long")).otherwise(F.pmod(s["x"], F.when(s["y"] == 0, F.lit(1)).otherwise(s["y"]))).alias("y")))
        return done["x"]

    each = pairs.withColumn("d", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).withColumn("c", F.col("a") + F.col("d"))
    fit = each.where((F.col("c") >= 1) & (gcd(F.col("c"), F.col("b")) == 1))
    return fit.groupBy("a", "b").agg(F.min_by("c", F.struct(F.abs("d"), -F.col("d"))).alias("coprime"))
