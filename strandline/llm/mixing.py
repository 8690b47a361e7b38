"""Temperature mixing of sources, realised as budgeted block permutations."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import keyed_rows, materialize

GRID = 64  # exponents tried in one round of the search
BLOCK = 4096  # rows in a block, about


@dataclass(frozen=True)
class Mix:
    """entropy: target entropy of the weights, as a share of the largest
    possible one; max_repeats: most often that a source may be read, on average
    over its tokens. One of the two is given. budget: tokens to draw; None: the
    least with which every source is read once at least, so that the mix leaves
    no document out."""

    max_repeats: float | None = 1.5
    entropy: float | None = None
    budget: int | None = None
    seed: int = 17


def _bisect_exponent(sources: DataFrame, mix: Mix) -> float:
    """The exponent between 0 (even weights) and 1 (shares as they are): for an
    entropy the largest that reaches it, for a repetition limit the smallest
    that respects it; 0 or 1 where no exponent between does. Every round tries
    GRID exponents in one aggregation over the table of sources."""
    lo, hi, answer = 0.0, 1.0, 1.0
    most = sources.agg(F.max("tokens")).head()[0]
    for _ in range(6):
        grid = [lo + (hi - lo) * i / (GRID - 1) for i in range(GRID)]
        each = sources.select("tokens", F.posexplode(F.array(*[F.lit(a) for a in grid])).alias("i", "a"))
        each = each.withColumn("w", F.exp(F.col("a") * (F.log("tokens") - math.log(most))))
        pace = F.col("w") / F.col("tokens")
        sums = F.sum("w").alias("z"), F.sum(F.col("w") * F.log("w")).alias("wlog"), F.max(pace).alias("fast"), F.min(pace).alias("slow"), F.count("*").alias("n")
        per = each.groupBy("i").agg(*sums).orderBy("i").collect()

        def good(r) -> bool:
            if mix.entropy is not None:
                return math.log(r.z) - r.wlog / r.z >= mix.entropy * math.log(max(r.n, 1)) - 1e-12
            repeats = r.fast / r.slow if mix.budget is None else mix.budget * r.fast / r.z
            return repeats <= mix.max_repeats * (1 + 1e-12)

        ok = [good(r) for r in per]
        if mix.entropy is not None:
            ok = ok[::-1]
        k = ok.index(True) if True in ok else GRID - 1
        if mix.entropy is not None:
            k = GRID - 1 - k
            lo, hi = grid[k], grid[min(k + 1, GRID - 1)]
            answer = lo
        else:
            lo, hi = grid[max(k - 1, 0)], grid[k]
            answer = hi
        if lo == hi:
            break
    return answer


def _order(seed: int, epoch: Column, rid: Column) -> Column:
    """Place in the epoch's permutation."""
    return F.xxhash64(F.lit(seed).cast("long"), epoch.cast("long"), rid)


def _quotas(shared: DataFrame, alpha: float, mix: Mix) -> DataFrame:
    """(of, all, quota): the tokens that each source (source, tokens) gives."""
    w = shared.select("source", "tokens", (F.col("tokens") ** F.lit(alpha)).alias("w"))
    if mix.budget is None:
        scale = w.agg((F.lit(1.0) / F.min(F.col("w") / F.col("tokens"))).alias("scale"))
    else:
        scale = w.agg((F.lit(float(mix.budget)) / F.sum("w")).alias("scale"))
    quota = F.floor(F.col("w") * F.col("scale") + F.lit(1e-6)).cast("long")
    if mix.budget is None:
        # doubles may round a large source's quota below its own tokens
        quota = F.greatest(quota, F.col("tokens"))
    return w.crossJoin(F.broadcast(scale)).select(F.col("source").alias("of"), F.col("tokens").alias("all"), quota.alias("quota"))


def mix_sources(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Weights are token shares to the power of an exponent, bisected to meet
    the target. Each source then gets its weight's part of the budget: whole
    passes (epochs) over its documents, and of one more the first documents of
    that epoch's permutation whose tokens the rest pays for. A permutation goes
    block by block, blocks by the leading bits of the hash, and by the whole
    hash within a block.

    Returns row (all columns that came in), epoch (0, 1, ...), n_tokens (words
    [^\\x20\\x09-\\x0D]+), block and place (the order within the epoch).

    A null source is a source. A null or empty text has no tokens; a source
    without tokens has no share and each of its documents is drawn once. Every
    row is a document, repeated rows and null ids too. An empty table gives
    none; other columns are carried along in row, whatever their names.

    Only numbers for each of GRID exponents reach the driver. A source may hold
    any part of the rows: its partial epoch is cut by sums over blocks, and only
    the one block at the cut is looked at row by row.
    """
    if (mix.entropy is None) == (mix.max_repeats is None):
        raise ValueError("give an entropy or a repetition limit")
    rows, _ = keyed_rows(docs, carry=True)
    tokens = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    source = F.col("row")["source"]
    sized = materialize(rows.select("rid", source.alias("source"), tokens.alias("n_tokens")), "tokens")
    per = materialize(sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")), "sources")
    shared = per.where("tokens > 0")
    n_rows = per.agg(F.sum("n")).head()[0] or 0
    bits = max(0, min(20, math.ceil(math.log2(max(1, n_rows / BLOCK)))))
    block = lambda place: (F.shiftrightunsigned(place, 64 - bits) if bits else F.lit(0)).cast("int")
    # unsigned order of the hash, so that blocks follow one another
    rank = lambda place: place.bitwiseXOR(F.lit(-(1 << 63)))
    alpha = _bisect_exponent(shared, mix) if shared.limit(1).head(1) else 1.0
    paid = _quotas(shared, alpha, mix)
    plan = per.select("source").join(paid, F.col("source").eqNullSafe(F.col("of")), "left").select("source", F.coalesce("all", F.lit(0)).alias("tokens"), F.coalesce("quota", F.lit(0)).alias("quota"))
    plan = materialize(
        plan.select(
            "source",
            F.when(F.col("tokens") > 0, F.expr("quota div tokens")).otherwise(F.lit(1)).alias("passes"),
            F.when(F.col("tokens") > 0, F.expr("quota % tokens")).otherwise(F.lit(0)).alias("rest"),
        ),
        "plan",
    )
    small = plan.count() <= 10_000
    hint = F.broadcast if small else lambda df: df
    place = _order(mix.seed, F.col("passes"), F.col("rid"))
    of_plan = plan.withColumnRenamed("source", "of")
    last = sized.join(hint(of_plan), F.col("source").eqNullSafe(F.col("of"))).where("rest > 0").select("source", "rid", "n_tokens", "rest", place.alias("place"))
    last = last.withColumn("block", block(F.col("place")))
    blocks = last.groupBy("source", "block", "rest").agg(F.sum("n_tokens").alias("tokens"))
    upto = F.sum("tokens").over(W.partitionBy("source").orderBy("block"))
    blocks = blocks.withColumn("before", upto - F.col("tokens"))
    # the block in which the rest runs out, or the last one
    edge = blocks.where("before <= rest").groupBy("source").agg(F.max(F.struct("block", "before")).alias("e"))
    edge = edge.select(F.col("source").alias("edge_of"), F.col("e.block").alias("edge"), F.col("e.before").alias("before"))
    at_edge = last.join(hint(edge), F.col("source").eqNullSafe(F.col("edge_of")) & (F.col("block") == F.col("edge")))
    spent = F.col("before") + F.sum("n_tokens").over(W.partitionBy("source", "block").orderBy(rank(F.col("place")), "rid"))
    cut = at_edge.withColumn("spent", spent).where("spent <= rest").groupBy("source").agg(F.max(F.struct(rank(F.col("place")).alias("rank"), "rid")).alias("cut"))
    cut = cut.select(F.col("source").alias("cut_of"), "cut")
    cuts = of_plan.join(edge, F.col("of").eqNullSafe(F.col("edge_of")), "left").join(cut, F.col("of").eqNullSafe(F.col("cut_of")), "left")
    cuts = materialize(cuts.select("of", "passes", "rest", "edge", "cut"), "cuts")
    joined = rows.select("rid", "row", source.alias("source"), tokens.alias("n_tokens")).join(hint(cuts), F.col("source").eqNullSafe(F.col("of")))
    own = F.struct(rank(place).alias("rank"), F.col("rid").alias("rid"))
    one_more = (F.col("rest") > 0) & ((block(place) < F.col("edge")) | ((block(place) == F.col("edge")) & (own <= F.col("cut"))))
    times = (F.col("passes") + F.when(F.coalesce(one_more, F.lit(False)), 1).otherwise(0)).cast("int")
    epochs = F.when(times > 0, F.sequence(F.lit(0), times - 1, F.lit(1)))
    drawn = joined.select("rid", "row", "n_tokens", F.explode(epochs).alias("epoch"))
    at = _order(mix.seed, F.col("epoch"), F.col("rid"))
    return drawn.select("row", "epoch", "n_tokens", block(at).alias("block"), rank(at).alias("place"))


def op8_temperature_mix(spark, sf_dir):
    """Every draw of the mix over all documents."""
    out = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("row.doc_id", "row.source", "epoch", "n_tokens", "block", "place")
