"""Quality rules as a bitmask ledger, in DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _pair_up(h: Column, step: int) -> Column:
    """From hashes of k words, hashes of k + step, where step <= k."""
    n = F.greatest(F.size(h) - step, F.lit(0))
    return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))


def _covered(windows: Column) -> Column:
    """Words in windows that are found twice or more, the first included."""

    def of_sorted(s: Column) -> Column:
        equal = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        twice = F.filter(s, lambda x, j: equal(x, j - 1) | equal(x, j + 1))
        return _let(
            F.array_sort(F.transform(twice, lambda x: x["i"])),
            lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x),
        )

    sort = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(_let(sort, of_sorted))


def _repeat_words(words: Column) -> Column:
    ids = F.transform(words, lambda w: F.xxhash64(w))
    return _let(ids, lambda a: _let(_pair_up(a, 1), lambda b: _let(_pair_up(b, 2), lambda c: _let(_pair_up(c, 4), _covered))))


def measurements(text: Column) -> Column:
    """A struct of everything that the rules look at, each part computed once."""

    def of_text(t: Column) -> Column:
        words = F.filter(F.split(t, SPACE), lambda w: w != "")
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        lost = lambda pattern: (F.char_length(t) - F.char_length(F.regexp_replace(t, pattern, ""))).cast("long")

        def of_words(w: Column) -> Column:
            return _let(
                lines,
                lambda x: F.struct(
                    F.size(w).cast("long").alias("n_words"),
                    F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
                    lost(r"[#*$%&|<>]").alias("n_symbols"),
                    F.size(x).cast("long").alias("n_lines"),
                    (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                    _repeat_words(w).alias("n_repeat_words"),
                ),
            )

        return _let(words, of_words)

    return _let(F.coalesce(text, F.lit("")), of_text)


@dataclass(frozen=True)
class Rule:
    """A document fails a rule where its condition on the measurements holds."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 10 * n_words"),
    Rule(3, "repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 20 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    """Rules that reject, by name. Policies are versioned; a ledger outlives them."""

    version: str
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        known = {r.name: r.bit for r in rules}
        return sum(1 << known[name] for name in set(self.rules))


BASE = Policy("base", ("few_words", "repeated_windows"))
POLICIES = (BASE, Policy("v1", ("few_words", "repeated_windows", "symbols", "repeated_lines", "short_words", "long_words")), Policy("lenient", ("few_words",)))
CURRENT = POLICIES[1]
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def rule_ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Evaluate every rule once on every whole text: (row: all input columns,
    the measurements, failed: a bit for each rule that the document fails).

    Words are [^\\x20\\x09-\\x0D]+. A null text is empty, so it fails few_words.
    Every row is judged by itself: ties, repeated rows and null ids make no
    difference, an empty table gives an empty ledger, and columns whose names
    clash with measurements stay apart inside row. Windows of eight words are
    compared by 64-bit hashes within one text.
    """
    m = measurements(F.col(text_col))
    # a generator, so that later filters on the measurements don't repeat them
    rows = docs.select(F.struct("*").alias("row"), F.inline_outer(F.array(m)))
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in rules]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return rows.select("row", *MEASURES, failed.alias("failed"))


def passes(failed: Column, policy: Policy, rules: tuple[Rule, ...] = RULES) -> Column:
    return failed.bitwiseAND(F.lit(policy.mask(rules)).cast("long")) == 0


def ablations(ledger: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each policy and rule of it: documents the policy rejects, those that
    fail the rule, and those that only this rule rejects (kept without it). The
    ledger is read once: rows are counted by their failure bits."""
    counts = ledger.groupBy("failed").agg(F.count("*").alias("n"))
    wanted = F.array(*[F.struct(F.lit(p.version).alias("policy"), F.lit(p.mask(rules)).cast("long").alias("mask"), F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for p in policies for r in rules if r.name in p.rules])
    each = counts.select("failed", "n", F.inline(wanted))
    own = F.col("failed").bitwiseAND(F.col("mask"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy("policy", "rule").agg(total(own != 0).alias("n_rejected"), total(own.bitwiseAND(F.col("bit")) != 0).alias("n_failing"), total(own == F.col("bit")).alias("n_by_rule_alone"))


def keep_passing(docs: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """The rows that the policy keeps, with the columns they came with."""
    return rule_ledger(docs).where(passes(F.col("failed"), policy)).select("row.*")


def op10_quality_ledger(spark, sf_dir):
    """Measurements and verdicts for all documents."""
    ledger = rule_ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = ~passes(F.col("failed"), BASE)
    return ledger.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & passes(F.col("failed"), CURRENT)).alias("kept"), "failed", F.lit(CURRENT.version).alias("policy"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
l AS (SELECT rid, len(x) AS n_lines, len(x) - len(list_distinct(x)) AS n_dup_lines
  FROM (SELECT rid, list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS x FROM d)),
w AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d)),
g AS (SELECT rid, i, list(word) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS win FROM w),
k AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM g WHERE len(win) = 8),
r AS (SELECT rid, count(DISTINCT j) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + 8)) AS j FROM k WHERE n > 1) GROUP BY rid),
m AS (SELECT d.doc_id,
    len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    n_lines, n_dup_lines::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d JOIN l USING (rid) LEFT JOIN r USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed = 0 AS kept, failed, 'v1' AS policy
FROM (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  ((n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT + 4 * (100 * n_symbols > 10 * n_words)::BIGINT
  + 8 * (100 * n_dup_lines > 50 * n_lines)::BIGINT + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 20 * n_words)::BIGINT) AS failed FROM m)
"""
