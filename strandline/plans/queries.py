"""Queries over the test tables, one or more for each operator, and the SQL that
gives the same rows in another engine."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.draws import MODULUS, draw, draw_sql
from ..functions.kernels import REF_KEY, slice_size
from ..operators import dataset, dependence, metrics, monitor, outliers, ranks, report, search
from ..sources import matrix
from ..streaming import indexes, policies, searcher
from .tables import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
D, M, SEED = 64, 20, 1  # elements of a vector, iterations, seed
SUBSPACE = [0, 1, 2]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- inputs: a numeric matrix, a mixed one, a ranking, a stream of pairs ------------------


def wide(spark, sf_dir) -> DataFrame:
    return dataset.array_matrix(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", D)


def full(spark, sf_dir) -> DataFrame:
    """All elements of the vectors, however many; for queries that have no SQL."""
    e = table(spark, sf_dir, "embeddings")
    return dataset.array_matrix(e, "vec_id", "embedding", e.agg(F.max(F.size("embedding"))).head()[0] or 0)


def long(spark, sf_dir) -> DataFrame:
    return dataset.to_long(wide(spark, sf_dir))


def mixed(spark, sf_dir) -> DataFrame:
    """Events as three columns: value (numeric), user modulo 20 (ordinal, many
    ties), event type (categorical)."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), F.col("value").cast("double").alias("x0"), F.pmod("user_id", F.lit(20)).cast("double").alias("x1"), "event_type")
    types = e.groupBy("event_type").agg(F.count("*")).select(F.col("event_type").alias("of"))
    names = types.agg(F.array_sort(F.collect_list("of")).alias("names"))
    coded = e.crossJoin(F.broadcast(names)).withColumn("x2", (F.array_position("names", F.col("event_type")) - 1).cast("double"))  # one row
    return dataset.to_long(coded.select("row_id", "x0", "x1", "x2"))


KINDS = {0: "n", 1: "o", 2: "c"}


def ranking(spark, sf_dir) -> DataFrame:
    """Labelled documents: is a long text one of low quality? Many scores tie."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select(F.col("doc_id").alias("row_id"), (F.floor(F.col("n_chars") / 50)).cast("double").alias("score"), (1 - F.col("quality")).cast("int").alias("y"))


def events(spark, sf_dir) -> DataFrame:
    """Events as rows of three numbers, numbered from 0 in their order."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("value").cast("double").alias("x0"), (F.pmod("user_id", F.lit(97)) + F.col("value") / 10).cast("double").alias("x1"), (F.length("event_type") * F.col("value")).cast("double").alias("x2"))
    return dataset.numbered(e, "event_id").select("row_id", "x0", "x1", "x2")


PAIR_WINDOW, PAIR_STEP = 200, 100


def gains(spark, sf_dir) -> DataFrame:
    """(t, arm, value, reward) of the pair stream, values cut to six digits."""
    stream = monitor.pair_stream(events(spark, sf_dir), PAIR_WINDOW, PAIR_STEP)
    return stream.select("t", "arm", F.round("value", 6).alias("value")).withColumn("reward", monitor.current_score(F.col("value")))


VECTORS = f"""e AS (SELECT vec_id AS row_id, unnest(range(0, {D}))::INT AS dim, unnest(embedding[1:{D}])::DOUBLE AS v FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY v, row_id) - 1 AS rk, count(*) OVER (PARTITION BY dim) AS n FROM e)"""
MIXED = """c AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS code FROM (SELECT DISTINCT event_type FROM events)),
e AS (SELECT event_id AS row_id, 0 AS dim, value::DOUBLE AS v FROM events
  UNION ALL SELECT event_id, 1, (user_id % 20)::DOUBLE FROM events
  UNION ALL SELECT event_id, 2, code::DOUBLE FROM events JOIN c USING (event_type)),
r AS (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY v, row_id) - 1 AS rk, count(*) OVER (PARTITION BY dim) AS n FROM e)"""
CORRECTED = """k AS (SELECT *, count(*) OVER (PARTITION BY dim, v) AS ties, rank() OVER (PARTITION BY dim ORDER BY v) AS first,
  row_number() OVER (PARTITION BY dim, v ORDER BY row_id) AS nth FROM r),
q AS (SELECT row_id, dim, v, rk, n, ties, first - 1 + (ties - 1) / 2.0 AS adj,
  sum(CASE WHEN nth = 1 THEN ties::DOUBLE * ties * ties - ties ELSE 0 END) OVER (PARTITION BY dim ORDER BY v) AS correction FROM k)"""
RANKING = """l AS (SELECT doc_id AS row_id, floor(n_chars / 50)::DOUBLE AS score, 1 - quality AS y FROM documents JOIN labels USING (doc_id)),
t AS (SELECT count(*) AS n, sum(y) AS p FROM l),
o AS (SELECT *, row_number() OVER w - 1 AS place, sum(y) OVER w AS tp, sum(1 - y) OVER w AS fp FROM l
  WINDOW w AS (ORDER BY score DESC, row_id ROWS UNBOUNDED PRECEDING))"""
STREAM = f"""s AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS row_id, value::DOUBLE AS x0,
  (user_id % 97 + value / 10)::DOUBLE AS x1, (length(event_type) * value)::DOUBLE AS x2 FROM events),
win AS (SELECT unnest(range(0, (SELECT (count(*) - {PAIR_WINDOW}) // {PAIR_STEP} + 1 FROM s))) AS t),
pv AS (SELECT t, corr(x1, x0) AS a0, corr(x2, x0) AS a1, corr(x2, x1) AS a2
  FROM win JOIN s ON s.row_id >= t * {PAIR_STEP} AND s.row_id < t * {PAIR_STEP} + {PAIR_WINDOW} GROUP BY t),
g AS (SELECT t, arm, round(value, 6) AS value, abs(round(value, 6)) AS reward FROM
  (SELECT t, 0 AS arm, a0 AS value FROM pv UNION ALL SELECT t, 1, a1 FROM pv UNION ALL SELECT t, 2, a2 FROM pv))"""


def its(m: int) -> str:
    return f"it AS (SELECT unnest(range(0, {m}))::INT AS it)"


def start_sql(size: str, it: str = "it", dim: str = "dim") -> str:
    return f"({draw_sql(SEED, it, dim)} % greatest(n - {size}, 1))"


def ks_sql(tested: str, keys: str, p_value: bool) -> str:
    """score by keys from tested (keys, rk, n, inside)."""
    if p_value:
        top, empty, d = "abs(a * (size - m) - (i - a) * m)", "m = 0 OR m = size", "top / (m * (size - m))"
        score = f"1 - 2 * list_sum([CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END * exp(-2.0 * k * k * z * z) FOR k IN range(1, 1001)])"
    else:
        top, empty, d, score = "abs(a * size - i * m)", "m = 0", "0", "top / (m * size)"
    return f"""walk AS (SELECT {keys}, sum(inside::BIGINT) OVER (PARTITION BY {keys} ORDER BY rk ROWS UNBOUNDED PRECEDING) AS a, rk + 1 AS i,
  sum(inside::BIGINT) OVER (PARTITION BY {keys}) AS m, n - 1 AS size FROM {tested} WHERE rk < n - 1),
tops AS (SELECT {keys}, max({top})::DOUBLE AS top, max(m)::BIGINT AS m, max(size)::BIGINT AS size FROM walk GROUP BY {keys}),
zs AS (SELECT *, {empty} AS empty, CASE WHEN {empty} THEN 0 ELSE {d} * sqrt((m * (size - m) // size)::DOUBLE) END AS z FROM tops),
scores AS (SELECT {keys}, CASE WHEN empty THEN 1.0 ELSE {score} END AS score FROM zs)"""


def safe_sql(cuts: str, keys: str, out: str) -> str:
    """Table out: cuts (dim, cut, keys) with the nearest boundary, safe."""
    return f"""{out} AS (SELECT c.dim, {keys}, c.cut, arg_min(b, 2 * abs(b - c.cut) + CASE WHEN b < c.cut THEN 1 ELSE 0 END) AS safe
  FROM {cuts} c JOIN bounds USING (dim) GROUP BY ALL)"""


BOUNDS = """bounds AS (SELECT dim, rk AS b FROM (SELECT dim, rk, v, lag(v) OVER (PARTITION BY dim ORDER BY rk) AS w FROM r) WHERE w IS NULL OR w <> v
  UNION ALL SELECT dim, max(n) FROM r GROUP BY dim)"""


# -- matrices, samples, logs ------------------------------------------------------------------


@query(f"WITH {VECTORS} SELECT row_id, dim, v FROM e")
def unpivot_long(spark, sf_dir):
    return long(spark, sf_dir)


@query(f"""WITH {VECTORS}, w AS (SELECT row_id, max(CASE WHEN dim = 0 THEN v END) AS x0, max(CASE WHEN dim = {D - 1} THEN v END) AS last FROM e GROUP BY row_id)
SELECT 'take' AS op, row_id, x0 AS v FROM w WHERE row_id < 10 UNION ALL SELECT 'drop', row_id, x0 FROM w WHERE row_id >= (SELECT max(row_id) FROM w) - 5
UNION ALL SELECT 'head', row_id, x0 FROM w WHERE row_id = (SELECT min(row_id) FROM w) UNION ALL SELECT 'last', row_id, last FROM w""")
def take_drop_head(spark, sf_dir):
    w = wide(spark, sf_dir)
    n = w.agg(F.max("row_id")).head()[0] or 0
    own = lambda name, df, c="x0": df.select(F.lit(name).alias("op"), "row_id", F.col(c).alias("v"))
    return own("take", dataset.take(w, 10)).unionByName(own("drop", dataset.drop(w, n - 5))).unionByName(own("head", dataset.head(w))).unionByName(own("last", dataset.column(w, -1), "v"))


@query(f"WITH {VECTORS} SELECT dim::BIGINT AS row_id, row_id AS dim, v FROM e")
def transpose_rows(spark, sf_dir):
    return dataset.transpose_long(long(spark, sf_dir))


@query(f"SELECT o_orderkey AS row_id FROM orders ORDER BY {draw_sql(SEED, 0, 'o_orderkey')}, o_orderkey LIMIT 1000")
def sample_1000(spark, sf_dir):
    """A sampling operator: the limit is what it is for."""
    return dataset.sample_rows(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id")), 1000, SEED)


@query("SELECT doc_id AS row_id, toxic > 0 AS is_outlier FROM labels")
def labels_positive(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"), (F.col("toxic") > 0).alias("is_outlier"))


@query("SELECT * FROM (VALUES (0, 'n'), (1, 'o'), (2, 'c')) AS t(dim, kind)")
def column_kinds(spark, sf_dir):
    w = dataset.with_kinds(dataset.to_wide(mixed(spark, sf_dir), 3), {"x1": "o", "x2": "c"})
    return spark.createDataFrame(list(enumerate(dataset.kinds_of(w))), "dim int, kind string")


@query(f"""WITH {VECTORS}, x AS (SELECT row_id AS step, dim, round(v, 4) AS score, round(v, 4) = 0 AS nought FROM e)
SELECT step, dim AS place, [dim, dim + 1] AS dims, CASE WHEN nought THEN 0.0 ELSE score END AS score FROM x""")
def subspace_log_roundtrip(spark, sf_dir):
    """Written as lines and read again: scores to four digits."""
    item = F.struct(F.array("dim", F.col("dim") + 1).alias("dims"), F.round("v", 4).alias("score"))
    steps = long(spark, sf_dir).groupBy(F.col("row_id").alias("step")).agg(F.array_sort(F.collect_list(item)).alias("subspaces"))
    back = matrix.parse_log(matrix.format_log(steps))
    out = back.select("step", F.posexplode("subspaces").alias("place", "s"))
    return out.select("step", "place", "s.dims", F.when(F.col("s.score") == 0, 0.0).otherwise(F.col("s.score")).alias("score"))


# -- ranks and slices -------------------------------------------------------------------------------


@query(f"WITH {VECTORS} SELECT row_id, dim, v, rk, n FROM r")
def rank_index(spark, sf_dir):
    return ranks.rank_index(long(spark, sf_dir))


@query(f"WITH {MIXED}, {CORRECTED} SELECT row_id, dim, v, rk, n, ties, adj, correction FROM q")
def rank_index_corrected(spark, sf_dir):
    return ranks.corrected_index(mixed(spark, sf_dir))


@query(f"WITH {MIXED} SELECT dim, v, list(row_id ORDER BY row_id) AS positions, count(*) AS n FROM e WHERE dim > 0 GROUP BY dim, v")
def count_index(spark, sf_dir):
    return ranks.count_index(mixed(spark, sf_dir).where("dim > 0"))


@query(f"""WITH {STREAM.split('pv AS')[0].rstrip().rstrip(',')}, l AS (SELECT t AS "window", row_id, x1 AS v FROM win JOIN s ON s.row_id >= t * {PAIR_STEP} AND s.row_id < t * {PAIR_STEP} + {PAIR_WINDOW})
SELECT "window", row_id, v, row_number() OVER (PARTITION BY "window" ORDER BY v, row_id) - 1 AS rk, count(*) OVER (PARTITION BY "window") AS n FROM l""")
def rank_index_sliding(spark, sf_dir):
    """What an incrementally kept index holds after each step."""
    e = events(spark, sf_dir).select("row_id", F.col("x1").alias("v"))
    rows = dataset.windows_of(e, dataset.row_count(e), PAIR_WINDOW, PAIR_STEP)
    return ranks.rank_index(rows, ("window",)).select("window", "row_id", "v", "rk", "n")


INDEX_WINDOW, INDEX_STEP = 20, 10
STREAMED = f"""e AS (SELECT (user_id % 20)::VARCHAR AS stream, 0 AS dim, event_id, value::DOUBLE AS v FROM events
  UNION ALL SELECT (user_id % 20)::VARCHAR, 1, event_id, (user_id % 7 + floor(value / 10))::DOUBLE FROM events),
p AS (SELECT *, row_number() OVER (PARTITION BY stream, dim ORDER BY event_id) - 1 AS place, count(*) OVER (PARTITION BY stream, dim) AS total FROM e),
s AS (SELECT stream, dim, unnest(range(0, total - {INDEX_WINDOW} + 1, {INDEX_STEP})) AS lo FROM (SELECT DISTINCT stream, dim, total FROM p)),
w AS (SELECT p.stream, p.dim, lo, lo + {INDEX_WINDOW} - 1 AS upto, place - lo AS pos, v AS value,
  count(*) OVER (PARTITION BY p.stream, p.dim, lo, v) AS ties, rank() OVER (PARTITION BY p.stream, p.dim, lo ORDER BY v) - 1 AS below,
  row_number() OVER (PARTITION BY p.stream, p.dim, lo, v ORDER BY place) AS nth FROM p JOIN s USING (stream, dim) WHERE place >= lo AND place < lo + {INDEX_WINDOW})"""


def _streamed(spark, sf_dir) -> DataFrame:
    """Two columns of the events of each of twenty groups of users, as streams."""
    e = table(spark, sf_dir, "events").select(F.pmod("user_id", F.lit(20)).cast("string").alias("stream"), F.col("event_id").alias("row_id"), "user_id", F.col("value").cast("double").alias("value"))
    cells = F.array(F.struct(F.lit(0).alias("dim"), F.col("value").alias("v")), F.struct(F.lit(1).alias("dim"), (F.pmod("user_id", F.lit(7)) + F.floor(F.col("value") / 10)).cast("double").alias("v")))
    return e.select("stream", "row_id", F.inline(cells))


@query(f"WITH {STREAMED} SELECT stream, dim, upto, pos, value, (below + nth - 1)::DOUBLE AS rk FROM w")
def stream_index_ranks(spark, sf_dir):
    return indexes.index_stream(_streamed(spark, sf_dir), INDEX_WINDOW, INDEX_STEP, "n").drop("correction", "ties")


@query(f"""WITH {STREAMED} SELECT stream, dim, upto, pos, value, below + (ties - 1) / 2.0::DOUBLE AS rk,
sum(CASE WHEN nth = 1 THEN ties::DOUBLE * ties * ties - ties ELSE 0 END) OVER (PARTITION BY stream, dim, lo ORDER BY value) AS correction, ties FROM w""")
def stream_index_corrected(spark, sf_dir):
    return indexes.index_stream(_streamed(spark, sf_dir), INDEX_WINDOW, INDEX_STEP, "o")


@query(f"WITH {STREAMED} SELECT stream, dim, upto, pos, value, (dense_rank() OVER (PARTITION BY stream, dim, lo ORDER BY value) - 1)::DOUBLE AS rk, ties FROM w")
def stream_index_counts(spark, sf_dir):
    return indexes.index_stream(_streamed(spark, sf_dir), INDEX_WINDOW, INDEX_STEP, "c").drop("correction")


@query(f"""WITH {VECTORS}, {its(M)} SELECT dim, it, row_id FROM r, it WHERE rk >= {start_sql('100')} AND rk < {start_sql('100')} + 100""")
def slice_numeric(spark, sf_dir):
    return ranks.numeric_slice(ranks.rank_index(long(spark, sf_dir)), 100, M, SEED).where("inside").select("dim", "it", "row_id")


SLICED = 300


@query(f"""WITH {MIXED}, {BOUNDS}, {its(5)}, c0 AS (SELECT DISTINCT dim, it, n, {start_sql(str(SLICED))} AS cut FROM r, it WHERE dim = 1),
{safe_sql('c0', 'c.it, c.n', 'c1')}, c2 AS (SELECT dim, it, n, safe AS a, least(safe + {SLICED}, n - 1) AS cut FROM c1), {safe_sql('c2', 'c.it, c.a', 'c3')},
x AS (SELECT r.dim, it, row_id, row_number() OVER (PARTITION BY it ORDER BY CASE WHEN rk >= a AND rk < safe THEN 0 ELSE 1 END, {draw_sql(SEED + 1, 'it', 'row_id')}, row_id) AS turn FROM r JOIN c3 USING (dim))
SELECT dim, it, row_id FROM x WHERE turn <= {SLICED}""")
def slice_ordinal(spark, sf_dir):
    r = ranks.rank_index(mixed(spark, sf_dir).where("dim = 1"))
    return ranks.ordinal_slice(r, SLICED, 5, SEED).where("inside").select("dim", "it", "row_id")


CATEGORIES = f"""cats AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code, count(*) OVER () AS n_cat FROM (SELECT DISTINCT v FROM r WHERE dim = 2)),
turns AS (SELECT *, row_number() OVER (PARTITION BY it ORDER BY {draw_sql(SEED, 'it', 'code')}, code) AS turn FROM cats, it)"""


@query(f"""WITH {MIXED}, {its(5)}, {CATEGORIES},
x AS (SELECT dim, it, row_id, row_number() OVER (PARTITION BY it ORDER BY CASE WHEN turn <= least(greatest(floor(n_cat * {SLICED} / n), 1), n_cat - 1) THEN 0 ELSE 1 END,
  {draw_sql(SEED + 1, 'it', 'row_id')}, row_id) AS nth FROM r JOIN turns USING (v) WHERE dim = 2)
SELECT dim, it, row_id FROM x WHERE nth <= {SLICED}""")
def slice_categorical(spark, sf_dir):
    r = ranks.rank_index(mixed(spark, sf_dir).where("dim = 2"))
    return ranks.categorical_slice(r, SLICED, 5, SEED).where("inside").select("dim", "it", "row_id")


@query(f"""WITH {MIXED}, {its(5)}, {CATEGORIES}, n AS (SELECT max(n) AS n FROM r WHERE dim = 2)
SELECT 2 AS dim, it, v FROM turns, n WHERE turn <= least(greatest(floor(n_cat * {SLICED} / n), 2), n_cat)""")
def category_restriction(spark, sf_dir):
    return ranks.category_restriction(ranks.rank_index(mixed(spark, sf_dir).where("dim = 2")), SLICED, 5, SEED)


@query(f"""WITH {VECTORS}, {its(M)} SELECT dim, it, row_id FROM r, it WHERE ((rk - {draw_sql(SEED, 'it', 'dim')} % n) % n + n) % n < 100""")
def slice_uniform(spark, sf_dir):
    return ranks.uniform_slice(ranks.rank_index(long(spark, sf_dir)), 100, M, SEED).where("inside").select("dim", "it", "row_id")


@query(f"""WITH {VECTORS}, {its(M)}, x AS (SELECT dim, it, row_id, ((rk - {draw_sql(SEED, 'it', 'dim')} % n) % n + n) % n < 200 AS inside FROM r, it)
SELECT it, row_id, bool_and(inside) AS inside FROM x WHERE dim IN (1, 2) GROUP BY it, row_id""")
def subspace_slice_uniform(spark, sf_dir):
    return ranks.subspace_uniform_slice(ranks.rank_index(long(spark, sf_dir)), SUBSPACE, 0, 200, M, SEED)


@query(f"""WITH {VECTORS}, {its(M)}, x AS (SELECT dim, it, row_id, rk >= {start_sql('200')} AND rk < {start_sql('200')} + 200 AS inside FROM r, it)
SELECT it, row_id, bool_and(inside) AS inside FROM x WHERE dim IN (1, 2) GROUP BY it, row_id""")
def subspace_slice(spark, sf_dir):
    return ranks.subspace_slice(ranks.numeric_slice(ranks.rank_index(long(spark, sf_dir)), 200, M, SEED), SUBSPACE, 0)


@query(f"""WITH {MIXED}, {BOUNDS}, {its(50)}, c0 AS (SELECT DISTINCT dim, it, {draw_sql(SEED, 'it', 'dim')} % (n + 1) AS cut FROM r, it), {safe_sql('c0', 'c.it', 'c1')}
SELECT dim, it, cut, safe FROM c1""")
def safe_cut(spark, sf_dir):
    r = ranks.rank_index(mixed(spark, sf_dir))
    cuts = ranks.with_iterations(r.select("dim", "n").distinct(), 50).select("dim", "it", (draw(SEED, "it", "dim") % (F.col("n") + 1)).cast("long").alias("cut"))
    return ranks.safe_cuts(ranks.boundaries(r), cuts).select("dim", "it", "cut", "safe")


@query("""WITH p AS (SELECT DISTINCT p_partkey % 97 + 1 AS a, p_size AS b FROM part), c AS (SELECT a, b, unnest(range(-64, 65)) AS d FROM p)
SELECT a, b, arg_min(a + d, 2 * abs(d) + CASE WHEN d < 0 THEN 1 ELSE 0 END) AS coprime FROM c WHERE a + d >= 1 AND gcd(a + d, b) = 1 GROUP BY a, b""")
def closest_coprime(spark, sf_dir):
    p = table(spark, sf_dir, "part").select((F.pmod("p_partkey", F.lit(97)) + 1).alias("a"), F.col("p_size").cast("long").alias("b")).distinct()
    return ranks.closest_coprime(p)


# -- dependence ----------------------------------------------------------------------------------------


def half(n: str = "n") -> str:
    return f"ceil(0.5 * {n})::BIGINT"


PAIRS = f"""sl AS (SELECT dim AS other, it, row_id, rk >= {start_sql(half())} AND rk < {start_sql(half())} + {half()} AS inside FROM r, {{its}})"""


def _index(spark, sf_dir):
    """A corrected index, written once, and the number of rows."""
    rows = long(spark, sf_dir)
    return materialize(ranks.corrected_index(rows), "index"), table(spark, sf_dir, "embeddings").count()


def _ranked(spark, sf_dir):
    """A rank index, written once, and the number of rows."""
    return materialize(ranks.rank_index(long(spark, sf_dir)), "index"), table(spark, sf_dir, "embeddings").count()


def _pair_matrix(test: str, where: str = "TRUE") -> str:
    return f"""WITH {VECTORS}, {its(M)}, {PAIRS.format(its='it')},
tested AS (SELECT r.dim, sl.other, sl.it, r.rk, r.n, sl.inside FROM r JOIN sl USING (row_id) WHERE r.dim <> sl.other AND {where}),
{ks_sql('tested', 'dim, other, it', test == 'ksp')} SELECT dim AS ref, other, round(avg(score), 6) AS score FROM scores GROUP BY dim, other"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


@query(_pair_matrix("ks"))
def ks_deviation_matrix(spark, sf_dir):
    index, n = _ranked(spark, sf_dir)
    return _rounded(dependence.deviation_matrix(index, n, "ks", M, seed=SEED))


@query(_pair_matrix("ksp"))
def deviation_matrix(spark, sf_dir):
    index, n = _ranked(spark, sf_dir)
    return _rounded(dependence.deviation_matrix(index, n, "ksp", M, seed=SEED))


@query(_pair_matrix("ksp", "r.dim IN (0, 3)"))
def deviation_matrix_partial(spark, sf_dir):
    index, n = _ranked(spark, sf_dir)
    return _rounded(dependence.deviation_matrix(index, n, "ksp", M, seed=SEED, refs=[0, 3]))


@query(f"""WITH {VECTORS}, {its(M)}, {PAIRS.format(its='it')},
tested AS (SELECT r.dim, sl.other, sl.it, r.rk, r.n, sl.inside FROM r JOIN sl USING (row_id) WHERE r.dim <> sl.other AND ({draw_sql(SEED, 'it', REF_KEY)} % 2 = 0) = (r.dim < sl.other)),
{ks_sql('tested', 'dim, other, it', True)} SELECT greatest(dim, other) AS x, least(dim, other) AS y, round(avg(score), 6) AS score FROM scores GROUP BY ALL""")
def contrast_matrix(spark, sf_dir):
    index, n = _ranked(spark, sf_dir)
    return _rounded(dependence.contrast_matrix(index, n, "ksp", M, seed=SEED))


def _subspace_sql(ref: str, size: str, test: str) -> str:
    """One score for SUBSPACE; ref: an expression of it for the reference."""
    return f"""WITH {VECTORS}, {its(M)}, z AS (SELECT *, {ref} AS ref FROM r, it WHERE dim IN ({', '.join(map(str, SUBSPACE))})),
x AS (SELECT it, row_id, ref, bool_and(dim = ref OR (rk >= {start_sql(size)} AND rk < {start_sql(size)} + {size})) AS inside FROM z GROUP BY it, row_id, ref),
tested AS (SELECT r.dim, it, rk, n, inside FROM x JOIN r ON r.dim = x.ref AND r.row_id = x.row_id),
{ks_sql('tested', 'dim, it', test == 'ksp')} SELECT round(avg(score), 6) AS score FROM scores"""


DRAWN_REF = f"[{', '.join(map(str, SUBSPACE))}][{draw_sql(SEED, 'it', REF_KEY)} % {len(SUBSPACE)} + 1]"
SIZE3 = "ceil(sqrt(0.5) * n)::BIGINT"
SIZE_ALPHA = f"ceil(sqrt(0.1 + ({draw_sql(SEED + 3, 'it', REF_KEY)} % 801) / 1000.0::DOUBLE) * n)::BIGINT"


@query(_subspace_sql("0", SIZE3, "ks"))
def ks_statistic(spark, sf_dir):
    index, n = _index(spark, sf_dir)
    return _rounded(dependence.subspace_score(index, n, SUBSPACE, 0, "ks", M, seed=SEED))


@query(_subspace_sql("0", SIZE3, "ksp"))
def ksp_pvalue(spark, sf_dir):
    index, n = _index(spark, sf_dir)
    return _rounded(dependence.subspace_score(index, n, SUBSPACE, 0, "ksp", M, seed=SEED))


@query(_subspace_sql("2", SIZE3, "ksp"))
def deviation_subspace(spark, sf_dir):
    index, n = _index(spark, sf_dir)
    return _rounded(dependence.subspace_score(index, n, SUBSPACE, 2, "ksp", M, seed=SEED))


@query(_subspace_sql(DRAWN_REF, SIZE3, "ksp"))
def contrast_subspace(spark, sf_dir):
    index, n = _index(spark, sf_dir)
    return _rounded(dependence.subspace_score(index, n, SUBSPACE, None, "ksp", M, seed=SEED))


@query(_subspace_sql(DRAWN_REF, SIZE_ALPHA, "ksp"))
def contrast_alpha(spark, sf_dir):
    index, n = _index(spark, sf_dir)
    return _rounded(dependence.subspace_score_alpha(index, n, SUBSPACE, None, "ksp", M, SEED))


@query(_subspace_sql("1", SIZE_ALPHA, "ksp"))
def deviation_alpha(spark, sf_dir):
    index, n = _index(spark, sf_dir)
    return _rounded(dependence.subspace_score_alpha(index, n, SUBSPACE, 1, "ksp", M, SEED))


ERF = "list_sum([exp((n + 1) * ln(2.0) - (n + 1) * ln(2.0) + (2 * n + 1) * ln(x) + n * ln(2.0) - ((n + 1) * ln(2.0) + lgamma(n + 1.5) - 0.5 * ln(pi()))) FOR n IN range(0, 200)]) * 2 / sqrt(pi()) * exp(-x * x)"
MWP_ROWS = f"""{CORRECTED}, {BOUNDS},
free AS (SELECT dim, n, floor(n * 0.5)::BIGINT AS f FROM (SELECT DISTINCT dim, n FROM r WHERE dim = {{ref}})),
c0 AS (SELECT dim, it, n, CASE WHEN f > 0 THEN {draw_sql(SEED + 2, 'it', REF_KEY)} % greatest(f, 1) ELSE 0 END AS cut FROM free, it), {safe_sql('c0', 'c.it, c.n', 'c1')},
c2 AS (SELECT dim, it, n, safe AS a, least(safe + floor(n * 0.5)::BIGINT, n - 1) AS cut FROM c1), {safe_sql('c2', 'c.it, c.n, c.a', 'c3')},
c4 AS (SELECT c.dim, c.it, c.a, c.safe AS b, c.n, count(*) FILTER (bounds.b > c.a AND bounds.b < c.safe) = 0 AS one,
  max(bounds.b) FILTER (bounds.b < c.a) AS lower, min(bounds.b) FILTER (bounds.b > c.safe) AS upper FROM c3 c JOIN bounds USING (dim) GROUP BY ALL),
c5 AS (SELECT dim, it, CASE WHEN one AND a > 0 THEN lower ELSE a END AS a, CASE WHEN one AND a = 0 AND b < n THEN upper ELSE b END AS b FROM c4),
mr AS (SELECT x.it, a, b, rk, adj, correction, inside FROM x JOIN q ON q.dim = {{ref}} AND q.row_id = x.row_id JOIN c5 ON c5.it = x.it AND c5.dim = q.dim),
ms AS (SELECT it, max(a) AS a, max(b) AS b, sum(CASE WHEN rk >= a AND rk < b AND inside THEN 2 * adj ELSE 0 END) AS r2, count(*) FILTER (rk >= a AND rk < b AND inside) AS n1,
  max(correction) FILTER (rk = b - 1) AS hi, coalesce(max(correction) FILTER (rk = a - 1), 0) AS lo FROM mr GROUP BY it),
mu AS (SELECT it, n1, b - a - n1 AS n2, abs(r2 / 2 - a * n1 - (n1 * (n1 - 1)) // 2 - n1 * (b - a - n1) / 2.0) AS u,
  n1 * (b - a - n1) / 12.0 * (b - a + 1 - (hi - lo) / nullif((b - a) * (b - a - 1), 0)) AS spread FROM ms),
mx AS (SELECT it, n1, n2, spread, CASE WHEN n1 > 0 AND n2 > 0 AND spread > 0 THEN greatest(u / sqrt(spread) / sqrt(2.0), 1e-12) END AS x FROM mu),
scores AS (SELECT it, CASE WHEN n1 = 0 OR n2 = 0 THEN 1.0 WHEN spread <= 0 THEN 0.0 WHEN x >= 6 THEN 1.0 ELSE {ERF} END AS score FROM mx)"""


@query(f"""WITH {VECTORS}, {its(M)}, x AS (SELECT it, row_id, bool_and(dim = 0 OR (rk >= {start_sql(SIZE3)} AND rk < {start_sql(SIZE3)} + {SIZE3})) AS inside FROM r, it WHERE dim IN (0, 1, 2) GROUP BY it, row_id),
{MWP_ROWS.format(ref=0)} SELECT round(avg(score), 6) AS score FROM scores""")
def mwp_pvalue(spark, sf_dir):
    index, n = _index(spark, sf_dir)
    return _rounded(dependence.subspace_score(index, n, SUBSPACE, 0, "mwp", M, seed=SEED))


MIXED_SLICE = f"x AS (SELECT it, row_id, rk >= {start_sql(half())} AND rk < {start_sql(half())} + {half()} AS inside FROM r, it WHERE dim = 0)"


@query(f"""WITH {MIXED}, {its(5)}, {MIXED_SLICE}, {MWP_ROWS.format(ref=1)} SELECT round(avg(score), 6) AS score FROM scores""")
def mwp_ties(spark, sf_dir):
    """The ordinal column against a slice of the numeric one."""
    index = materialize(ranks.corrected_index(mixed(spark, sf_dir)), "index")
    return _rounded(dependence.subspace_score(index, table(spark, sf_dir, "events").count(), [0, 1], 1, "mwp", 5, seed=SEED))


CSP_ROWS = """p AS (SELECT it, v, count(*) AS t, sum(inside::BIGINT) AS o FROM r JOIN x USING (row_id) WHERE dim = 2 GROUP BY it, v),
w AS (SELECT *, sum(t) OVER (PARTITION BY it) AS n, sum(o) OVER (PARTITION BY it) AS n1 FROM p),
u AS (SELECT it, count(*) AS c, max(n) AS n, max(n1) AS n1, sum((o - t * n1 / n) ** 2 / (t * n1 / n) + (t - o - t * (n - n1) / n) ** 2 / (t * (n - n1) / n)) AS chi FROM w GROUP BY it),
h AS (SELECT *, (c - 1) / 2.0 AS a, chi / 2 AS h FROM u),
c_scores AS (SELECT it, CASE WHEN c = 1 THEN 0.0 WHEN n1 = 0 OR n1 = n THEN 1.0 WHEN h > a + 40 * sqrt(a) + 60 THEN 1.0
  ELSE least(1.0, list_sum([exp((a + k) * ln(h) - h - lgamma(a + k + 1)) FOR k IN range(0, 400)])) END AS score FROM h)"""


@query(f"WITH {MIXED}, {its(5)}, {MIXED_SLICE}, {CSP_ROWS} SELECT round(avg(score), 6) AS score FROM c_scores")
def csp_pvalue(spark, sf_dir):
    """The categorical column against a slice of the numeric one."""
    index = ranks.corrected_index(mixed(spark, sf_dir))
    return _rounded(dependence.subspace_score(index, table(spark, sf_dir, "events").count(), [0, 2], 2, "csp", 5, seed=SEED))


MCDEP_SLICES = f"""o0 AS (SELECT DISTINCT dim, it, n, {start_sql(SIZE3)} AS cut FROM r, it WHERE dim = 1),
{safe_sql('o0', 'c.it, c.n', 'o1')}, o2 AS (SELECT dim, it, n, safe AS a, least(safe + {SIZE3}, n - 1) AS cut FROM o1), {safe_sql('o2', 'c.it, c.a', 'o3')},
sl AS (SELECT dim, it, row_id, rk >= {start_sql(SIZE3)} AND rk < {start_sql(SIZE3)} + {SIZE3} AS inside FROM r, it WHERE dim = 0
  UNION ALL SELECT r.dim, it, row_id, row_number() OVER (PARTITION BY it ORDER BY CASE WHEN rk >= a AND rk < safe THEN 0 ELSE 1 END, {draw_sql(SEED + 1, 'it', 'row_id')}, row_id) <= {SIZE3} FROM r JOIN o3 USING (dim)
  UNION ALL SELECT dim, it, row_id, row_number() OVER (PARTITION BY it ORDER BY CASE WHEN turn <= least(greatest(floor(n_cat * {SIZE3} / n), 1), n_cat - 1) THEN 0 ELSE 1 END,
    {draw_sql(SEED + 1, 'it', 'row_id')}, row_id) <= {SIZE3} FROM r JOIN turns USING (v) WHERE dim = 2),
x AS (SELECT it, row_id, {draw_sql(SEED, 'it', REF_KEY)} % 3 AS ref, bool_and(inside OR dim = ref) AS inside FROM sl GROUP BY it, row_id)"""


@query(f"""WITH {MIXED}, {its(5)}, {BOUNDS}, {CATEGORIES}, {MCDEP_SLICES}, {MWP_ROWS.format(ref=1).replace(BOUNDS + ',', '').replace('scores AS', 'o_scores AS')},
tested AS (SELECT x.it, rk, n, inside FROM x JOIN r USING (row_id) WHERE dim = 0), {ks_sql('tested', 'it', True).replace('scores AS', 'n_scores AS')}, {CSP_ROWS}
SELECT round(avg(score), 6) AS score FROM (SELECT 0 AS ref, * FROM n_scores UNION ALL SELECT 1, * FROM o_scores UNION ALL SELECT 2, * FROM c_scores) JOIN (SELECT DISTINCT it, ref FROM x) USING (it, ref)""")
def mcdep_mixed(spark, sf_dir):
    """Contrast of columns of three kinds, each by its own test and slice."""
    index = materialize(ranks.corrected_index(mixed(spark, sf_dir)), "index")
    return _rounded(dependence.subspace_score(index, table(spark, sf_dir, "events").count(), [0, 1, 2], None, "mcdep", 5, seed=SEED, kinds=KINDS))


CONTRAST_WINDOW, CONTRAST_STEP = 100, 20
CONTRAST_SETS = [[0, 1], [2, 3, 4]]


def _contrast_sql(sets: list[list[int]], carried: bool) -> str:
    """Fresh contrasts of the windows at 0 and 1, 1 + step, ...; smoothed at each
    of them and carried on, or smoothed at every position with the latest one."""
    w, step, m = CONTRAST_WINDOW, CONTRAST_STEP, 10
    each = ", ".join(f"{{'subspace': {i}, 'dims': {dims}, 'size': {slice_size(w, 0.5, len(dims))}}}" for i, dims in enumerate(sets))
    at = start_sql("size")
    fresh = f"""{VECTORS.split('r AS')[0]} {its(m)}, ps AS (SELECT unnest(range(0, max(row_id) + {2 - w})) AS position FROM e),
ss AS (SELECT o.subspace, o.dims, o.size FROM (SELECT unnest([{each}]) AS o)),
wr AS (SELECT position, dim, row_id, row_number() OVER (PARTITION BY position, dim ORDER BY v, row_id) - 1 AS rk, {w} AS n
  FROM e JOIN ps ON row_id >= position AND row_id < position + {w} WHERE position = 0 OR (position - 1) % {step} = 0),
xs AS (SELECT subspace, position, it, row_id, dims[{draw_sql(SEED, 'it', REF_KEY)} % len(dims) + 1] AS ref, bool_and(dim = ref OR (rk >= {at} AND rk < {at} + size)) AS inside
  FROM wr JOIN ss ON list_contains(dims, dim), it GROUP BY subspace, position, it, row_id, ref),
tested AS (SELECT subspace, xs.position, it, rk, n, inside FROM xs JOIN wr ON wr.position = xs.position AND wr.row_id = xs.row_id AND dim = ref),
{ks_sql('tested', 'subspace, position, it', True)}, fr AS (SELECT subspace, position, avg(score) AS fresh FROM scores GROUP BY subspace, position)"""
    smoothed = """o AS (SELECT *, row_number() OVER (PARTITION BY subspace ORDER BY position) AS k FROM {rows}),
sm AS (SELECT subspace, position, k, fresh AS score FROM o WHERE k = 1
  UNION ALL SELECT o.subspace, o.position, o.k, 0.9 * score + 0.1 * fresh FROM sm JOIN o ON o.subspace = sm.subspace AND o.k = sm.k + 1)"""
    latest = "SELECT subspace, ps.position, {value} FROM (SELECT * FROM ps, (SELECT subspace FROM ss)) ps ASOF JOIN {rows} f USING (subspace, position)"
    if carried:
        return f"WITH RECURSIVE {fresh}, {smoothed.format(rows='fr')} {latest.format(value='round(score, 6) AS score', rows='sm')}"
    return f"WITH RECURSIVE {fresh}, la AS ({latest.format(value='fresh', rows='fr')}), {smoothed.format(rows='la')} SELECT subspace, position, round(score, 6) AS score FROM sm"


@query(_contrast_sql([list(range(D))], False))
def stream_contrast_ewma(spark, sf_dir):
    return _rounded(searcher.stream_contrast(full(spark, sf_dir), CONTRAST_WINDOW, CONTRAST_STEP, m=10))


@query(_contrast_sql(CONTRAST_SETS, True))
def stream_contrast_multi(spark, sf_dir):
    return _rounded(searcher.stream_contrast(wide(spark, sf_dir), CONTRAST_WINDOW, CONTRAST_STEP, CONTRAST_SETS, m=10))


# -- searches --------------------------------------------------------------------------------------------

#: Level 2: pairs of suppliers' and lines' numbers with the largest discounted price.
LEVEL_SQL = """lv AS (SELECT [least(a, b), greatest(a, b)] AS dims, max(l_extendedprice * (1 - l_discount))::DOUBLE AS score
  FROM (SELECT *, (l_suppkey % 6)::INT AS a, ((l_linenumber + l_orderkey) % 9)::INT AS b FROM lineitem) WHERE a <> b GROUP BY ALL)"""
JOIN_SQL = "cj AS (SELECT DISTINCT list_sort(list_distinct(list_concat(a.dims, b.dims))) AS dims FROM lv a, lv b WHERE len(list_intersect(a.dims, b.dims)) = 1)"
PRUNE_SQL = "pr AS (SELECT dims FROM cj WHERE (SELECT count(*) FROM lv WHERE list_has_all(cj.dims, lv.dims)) = 3)"
ABOVE_SQL = "up AS (SELECT pr.dims, avg(score) AS score FROM pr JOIN lv ON list_has_all(pr.dims, lv.dims) GROUP BY pr.dims)"


def _level(spark, sf_dir) -> DataFrame:
    a, b = F.pmod("l_suppkey", F.lit(6)).cast("int"), F.pmod(F.col("l_linenumber") + F.col("l_orderkey"), F.lit(9)).cast("int")
    rows = table(spark, sf_dir, "lineitem").withColumn("a", a).withColumn("b", b).where("a <> b")
    return rows.groupBy(F.array(F.least("a", "b"), F.greatest("a", "b")).alias("dims")).agg(F.max(F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("double").alias("score"))


def _above(spark, sf_dir) -> DataFrame:
    """Sets of three with the mean score of the pairs they hold."""
    level = _level(spark, sf_dir)
    pairs = search.prune_candidates(search.candidate_join(level), level).select("dims", F.explode(F.array(*[F.array(F.col("dims")[i], F.col("dims")[j]) for i, j in ((0, 1), (0, 2), (1, 2))])).alias("pair"))
    return pairs.join(level.select(F.col("dims").alias("pair"), "score"), "pair").groupBy("dims").agg(F.avg("score").alias("score"))


@query(f"WITH {LEVEL_SQL}, {JOIN_SQL} SELECT dims FROM cj")
def levelwise_candidates(spark, sf_dir):
    return search.candidate_join(_level(spark, sf_dir))


@query(f"WITH {LEVEL_SQL}, {JOIN_SQL}, {PRUNE_SQL} SELECT dims FROM pr")
def levelwise_prune(spark, sf_dir):
    return search.prune_candidates(search.candidate_join(_level(spark, sf_dir)), _level(spark, sf_dir))


@query(f"WITH {LEVEL_SQL}, {JOIN_SQL}, {PRUNE_SQL}, {ABOVE_SQL} SELECT dims, round(score, 4) AS score FROM lv WHERE NOT EXISTS (SELECT 1 FROM up WHERE list_has_all(up.dims, lv.dims) AND lv.score < up.score)")
def levelwise_redundancy(spark, sf_dir):
    return search.drop_redundant(_level(spark, sf_dir), _above(spark, sf_dir)).withColumn("score", F.round("score", 4))


@query(f"WITH {LEVEL_SQL} SELECT dims, round(score, 4) AS score FROM lv ORDER BY score DESC, dims LIMIT 5")
def levelwise_top(spark, sf_dir):
    """A top-k report."""
    return search.top_sets(_level(spark, sf_dir), 5).withColumn("score", F.round("score", 4))


@query()
def levelwise_search(spark, sf_dir):
    return _rounded(search.levelwise_search(full(spark, sf_dir)))


@query()
def greedy_search(spark, sf_dir):
    return _rounded(search.greedy_search(full(spark, sf_dir)))


# -- streaming search ----------------------------------------------------------------------------------------


@query(f"""WITH {VECTORS}, s AS (SELECT dim, max(v) AS score FROM e GROUP BY dim)
SELECT 'all' AS policy, dim FROM s UNION ALL (SELECT 'worst', dim FROM s ORDER BY score, dim LIMIT 3) UNION ALL (SELECT 'random', dim FROM s ORDER BY {draw_sql(4, 0, 'dim')}, dim LIMIT 3)""")
def select_dimensions(spark, sf_dir):
    """Which columns the stateless selectors search anew."""
    s = long(spark, sf_dir).groupBy("dim").agg(F.max("v").alias("score"))
    worst, rand = s.orderBy("score", "dim").limit(3), s.orderBy(draw(4, 0, "dim"), "dim").limit(3)
    own = lambda name, df: df.select(F.lit(name).alias("policy"), "dim")
    return own("all", s).unionByName(own("worst", worst)).unionByName(own("random", rand))


def _streams(spark, sf_dir) -> DataFrame:
    """Customers of each region as a stream of three columns."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    c = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
    x = [F.col("c_acctbal"), F.pmod("c_custkey", F.lit(97)) + F.col("c_acctbal") / 1000, F.length("c_mktsegment") + F.pmod("c_custkey", F.lit(7)) / 7]
    return c.select(F.col("n_regionkey").cast("string").alias("stream"), F.col("c_custkey").cast("long").alias("row_id"), *[v.cast("double").alias(f"x{i}") for i, v in enumerate(x)])


def _search(policy: str):
    def run(spark, sf_dir):
        return searcher.search_stream(_streams(spark, sf_dir), searcher.Search(m=8, policy=policy, window=20, step=5, monitor=False))

    run.__name__ = f"stream_search_{policy}"
    return run


for _policy in ("all", "none", "random", "worst", "mpts", "sts", "stsadwin"):
    query()(_search(_policy))


# -- outliers -----------------------------------------------------------------------------------------------------


def _lof_sql(windows: str, sets: str, size: int) -> str:
    """Mean score of each row over windows (w, first, last) and sets (s, dims) of
    columns from 1 on; rows p (row_id, x) are numbered 0, 1, ..."""
    return f"""p AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id AS row_id, embedding::DOUBLE[] AS x FROM embeddings), {windows}, {sets},
m AS (SELECT w, s, dims, r, row_id, [x[k] FOR k IN dims] AS x FROM ws JOIN p ON r BETWEEN first AND last, sets),
d AS (SELECT a.w, a.s, a.row_id AS i, b.row_id AS j, sqrt(list_sum([power(a.x[k] - b.x[k], 2) FOR k IN range(1, len(a.dims) + 1)])) AS d
  FROM m a JOIN m b ON a.w = b.w AND a.s = b.s AND a.row_id <> b.row_id),
k AS (SELECT *, row_number() OVER (PARTITION BY w, s, i ORDER BY d, j) AS nth FROM d), kd AS (SELECT w, s, i, max(d) AS kth FROM k WHERE nth <= {size} GROUP BY w, s, i),
nb AS (SELECT d.* FROM d JOIN kd USING (w, s, i) WHERE d.d <= kd.kth),
den AS (SELECT nb.w, nb.s, nb.i, count(*) / sum(greatest(nb.d, kd.kth)) AS lrd FROM nb JOIN kd ON kd.w = nb.w AND kd.s = nb.s AND kd.i = nb.j GROUP BY nb.w, nb.s, nb.i),
sc AS (SELECT nb.w, nb.s, nb.i, avg(b.lrd / a.lrd) AS score FROM nb JOIN den a ON a.w = nb.w AND a.s = nb.s AND a.i = nb.i JOIN den b ON b.w = nb.w AND b.s = nb.s AND b.i = nb.j GROUP BY nb.w, nb.s, nb.i),
pw AS (SELECT w, i, avg(score) AS score FROM sc GROUP BY w, i)
SELECT i AS row_id, round(avg(score), 6) AS score FROM pw GROUP BY i"""


WHOLE = "ws AS (SELECT 0 AS w, 0 AS first, count(*) - 1 AS last FROM p)"
ALL_DIMS = "sets AS (SELECT 0 AS s, range(1, len(x) + 1) AS dims FROM p WHERE r = 0)"


def _some(sets: list[list[int]]) -> str:
    return "sets AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {[d + 1 for d in x]})" for i, x in enumerate(sets)) + ") AS t(s, dims))"


@query("WITH " + _lof_sql(WHOLE, ALL_DIMS, 10))
def lof_full(spark, sf_dir):
    return _rounded(outliers.full_space_lof(wide(spark, sf_dir), 10))


@query("WITH " + _lof_sql(WHOLE, _some([[0, 1], [2, 3, 4]]), 10))
def lof_subspaces(spark, sf_dir):
    return _rounded(outliers.subspace_miner(wide(spark, sf_dir), [[0, 1], [2, 3, 4]], "lof", 10))


EVENTS = """e3 AS (SELECT event_id AS id, row_number() OVER (ORDER BY event_id) - 1 AS row_id, [value::DOUBLE, (user_id % 97 + value / 10)::DOUBLE, (length(event_type) * value)::DOUBLE] AS x FROM events),
e AS (SELECT row_id, unnest(range(0, 3))::INT AS dim, unnest(x) AS v FROM e3)"""


def _hash_sql(matrix: str, reps: int, ensemble: bool) -> str:
    unit = lambda seed, a, b: f"({draw_sql(seed, a, b)} / {MODULUS}.0::DOUBLE)"
    if ensemble:
        top = "ln(s) / ln(greatest(2, 1 / f))"
        chosen = f"""fr AS (SELECT *, round(1 + {top} / 2 + {unit(SEED + 6, 'rep', 0)} * ({top} - 1 - {top} / 2)) AS want FROM fs),
own AS (SELECT * FROM (SELECT fr.*, dim, lo, hi, row_number() OVER (PARTITION BY rep ORDER BY {draw_sql(SEED + 7, 'rep', 'dim')}, dim) AS nth, count(*) OVER (PARTITION BY rep) AS n_live FROM fr JOIN b USING (rep)) WHERE nth <= greatest(1, least(want, n_live)))"""
    else:
        chosen = "own AS (SELECT * FROM fs JOIN b USING (rep))"
    return f"""WITH {matrix}, ids AS (SELECT DISTINCT row_id FROM e), n AS (SELECT count(*) AS n, least(1000, count(*)) AS s FROM ids), rp AS (SELECT unnest(range(0, {reps}))::INT AS rep),
sm AS (SELECT rep, row_id FROM (SELECT rep, row_id, row_number() OVER (PARTITION BY rep ORDER BY {draw_sql(SEED, 'rep', 'row_id')}, row_id) AS k FROM rp, ids) WHERE k <= 1000),
b AS (SELECT rep, dim, min(v) AS lo, max(v) AS hi FROM e JOIN sm USING (row_id) GROUP BY rep, dim HAVING max(v) > min(v)),
fs AS (SELECT rep, s, 1 / sqrt(s) + {unit(SEED + 5, 'rep', 0)} * (1 - 2 * (1 / sqrt(s))) AS f FROM rp, n), {chosen},
c AS (SELECT rep, dim, row_id, floor(((v - lo) / (hi - lo) + {unit(SEED + 8, 'rep', 'dim')} * f) / f)::BIGINT AS cell FROM own JOIN e USING (dim)),
j AS (SELECT unnest(range(0, 4))::INT AS j), h AS (SELECT rep, row_id, j, sum({draw_sql(f'({SEED + 11} + j)', 'dim', 'cell + 1000000')}) % 10000 AS h FROM c, j GROUP BY rep, row_id, j),
k AS (SELECT rep, j, h, count(*) AS k FROM h JOIN sm USING (rep, row_id) GROUP BY rep, j, h),
l AS (SELECT h.rep, h.row_id, min(coalesce(k, 0)) + max(CASE WHEN sm.row_id IS NULL THEN 1 ELSE 0 END) AS k FROM h LEFT JOIN k ON k.rep = h.rep AND k.j = h.j AND k.h = h.h
  LEFT JOIN sm ON sm.rep = h.rep AND sm.row_id = h.row_id GROUP BY h.rep, h.row_id)
SELECT row_id, round(avg(-log2(k)), 6) AS score FROM l GROUP BY row_id"""


@query(_hash_sql(VECTORS, 1, False))
def rshash_single(spark, sf_dir):
    return _rounded(outliers.rs_hash(wide(spark, sf_dir), 1, SEED, False))


@query(_hash_sql(VECTORS, 25, True))
def rshash_ensemble(spark, sf_dir):
    return _rounded(outliers.rs_hash(wide(spark, sf_dir), 25, SEED, True))


@query(_hash_sql(EVENTS, 5, True))
def rshash_sampled(spark, sf_dir):
    """Rows beyond the sample of each repetition count themselves."""
    return _rounded(outliers.rs_hash(events(spark, sf_dir), 5, SEED, True))


@query("WITH " + _lof_sql("ws AS (SELECT w, w * 50 AS first, w * 50 + 99 AS last FROM (SELECT unnest(range(0, (count(*) - 100) // 50 + 1)) AS w FROM p))", _some([[0, 1], [2, 3]]), 10))
def stream_miner_lof(spark, sf_dir):
    return _rounded(outliers.stream_miner(wide(spark, sf_dir), 100, 50, "lof", 10, {-1: [[0, 1], [1, 0], [2, 3]]}, distinct=True))


@query()
def stream_miner_hash(spark, sf_dir):
    return _rounded(outliers.stream_miner(full(spark, sf_dir), 100, 50, "hash"))


@query("WITH " + _lof_sql("ws AS (SELECT w, w * 50 AS first, w * 50 + 99 AS last FROM (SELECT unnest(range(0, (count(*) - 1) // 50 + 1)) AS w FROM p))", ALL_DIMS, 10))
def stream_miner_full(spark, sf_dir):
    return _rounded(outliers.stream_miner(full(spark, sf_dir), 100, 50, "lof", 10))


@query("WITH " + _lof_sql("ws AS (SELECT w, w * 100 AS first, w * 100 + 99 AS last FROM (SELECT unnest(range(0, count(*) // 100)) AS w FROM p))", _some([[0, 1], [5, 9, 63]]), 10))
def stream_miner_logged(spark, sf_dir):
    """Windows scored in the subspaces that a log of a search names."""
    w = wide(spark, sf_dir)
    n = dataset.row_count(w)
    line = F.lit("1,0:0.5;63,5,9:0.25;0,1:0.1")
    log = matrix.parse_log(spark.range(n - 99).select(F.col("id").alias("step"), line.alias("line")))
    return _rounded(outliers.logged_miner(w, log, 100, 100))


@query("SELECT DISTINCT l_linenumber % 4 AS key, list_sort(list_distinct([(l_quantity % 5)::INT, l_linenumber % 5])) AS dims FROM lineitem")
def distinct_subspaces(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.pmod("l_linenumber", F.lit(4)).alias("key"), F.array(F.pmod("l_quantity", F.lit(5.0)).cast("int"), F.pmod("l_linenumber", F.lit(5)).cast("int")).alias("dims"))
    return outliers.distinct_subspaces(li)


# -- windows, pairs, policies ---------------------------------------------------------------------------------------


@query(f"""WITH {STREAM.split('pv AS')[0].rstrip().rstrip(',')} SELECT t AS "window", count(*) AS n, min(row_id) AS first, max(row_id) AS last
FROM win JOIN s ON s.row_id >= t * {PAIR_STEP} AND s.row_id < t * {PAIR_STEP} + {PAIR_WINDOW} GROUP BY t""")
def hopping_windows(spark, sf_dir):
    e = events(spark, sf_dir)
    return dataset.windows_of(e, dataset.row_count(e), PAIR_WINDOW, PAIR_STEP).groupBy("window").agg(F.count("*").alias("n"), F.min("row_id").alias("first"), F.max("row_id").alias("last"))


@query(f"WITH {STREAM} SELECT t, arm, value FROM g")
def pair_stream_pearson(spark, sf_dir):
    return gains(spark, sf_dir).select("t", "arm", "value")


@query(f"WITH {STREAM} SELECT t, arm, value FROM g WHERE arm IN (0, 2)")
def pair_stream_selected(spark, sf_dir):
    s = monitor.pair_stream(events(spark, sf_dir), PAIR_WINDOW, PAIR_STEP, [0, 2])
    return s.select("t", "arm", F.round("value", 6).alias("value"))


@query(f"WITH {STREAM} SELECT t, arm, value FROM g WHERE t = 3")
def replay_step(spark, sf_dir):
    """One step of the cached stream, which is what a replay reads."""
    return monitor.replay(gains(spark, sf_dir).select("t", "arm", "value"), 3)


@query(f"WITH {STREAM} SELECT t, arm, (CASE WHEN abs(value) >= 0.1 THEN 1 ELSE 0 END)::DOUBLE AS reward FROM g")
def reward_absolute(spark, sf_dir):
    return gains(spark, sf_dir).select("t", "arm", monitor.absolute_threshold(F.col("value"), 0.1).alias("reward"))


@query(f"WITH {STREAM} SELECT t, arm, (CASE WHEN abs(value - coalesce(lag(value) OVER (PARTITION BY arm ORDER BY t), 0)) > 0.05 THEN 1 ELSE 0 END)::DOUBLE AS reward FROM g")
def reward_relative(spark, sf_dir):
    g = gains(spark, sf_dir).withColumn("old", monitor.before())
    return g.select("t", "arm", monitor.relative_threshold(F.col("value"), F.col("old"), 0.05).alias("reward"))


@query(f"WITH {STREAM} SELECT t, arm, reward FROM g")
def reward_score(spark, sf_dir):
    return gains(spark, sf_dir).select("t", "arm", "reward")


def _top_sql(order: str) -> str:
    return f"WITH {STREAM} SELECT t, arm, reward FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY {order}, arm) AS k FROM g) WHERE k <= 2"


@query(_top_sql("reward DESC"))
def oracle_dynamic(spark, sf_dir):
    return monitor.oracle_dynamic(gains(spark, sf_dir).select("t", "arm", "reward"), 2)


@query(_top_sql("reward"))
def oracle_worst(spark, sf_dir):
    return monitor.oracle_worst(gains(spark, sf_dir).select("t", "arm", "reward"), 2)


@query(_top_sql(draw_sql(SEED, "t", "arm")))
def oracle_random(spark, sf_dir):
    return monitor.oracle_random(gains(spark, sf_dir).select("t", "arm", "reward"), 2, SEED)


@query(f"WITH {STREAM} SELECT t, arm, reward FROM g WHERE arm IN (SELECT arm FROM g GROUP BY arm ORDER BY round(sum(reward), 9) DESC, arm LIMIT 2)")
def oracle_static(spark, sf_dir):
    return monitor.oracle_static(gains(spark, sf_dir).select("t", "arm", "reward"), 2)


@query(f"WITH {STREAM} SELECT t, arm, reward FROM g WHERE ((arm - t * 2) % 3 + 3) % 3 < 2")
def oracle_sequential(spark, sf_dir):
    return monitor.oracle_sequential(gains(spark, sf_dir).select("t", "arm", "reward"), 2, 3)


ROUNDS = f"""ro AS (SELECT t AS round, arm, arm < 1 + t % 2 AS played, t + 1 AS t, reward, sum(reward) OVER (PARTITION BY arm ORDER BY t ROWS UNBOUNDED PRECEDING) AS total, (t + 1)::DOUBLE AS cnt FROM g)"""


def _rounds(spark, sf_dir) -> DataFrame:
    """Steps of the pair stream as rounds: one or two arms of three are played,
    and what each has gained so far is known."""
    w = W.partitionBy("arm").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    g = gains(spark, sf_dir)
    return g.select(F.col("t").alias("round"), "arm", (F.col("arm") < 1 + F.pmod("t", F.lit(2))).alias("played"), (F.col("t") + 1).alias("t"), "reward", F.sum("reward").over(w).alias("sum"), (F.col("t") + 1).cast("double").alias("cnt"))


@query(f"""WITH {STREAM}, {ROUNDS}, sc AS (SELECT round, avg(reward) AS eff, avg(total / cnt) AS far, count(*) AS k FROM ro WHERE played GROUP BY round)
SELECT round, CASE WHEN eff < 0.1 THEN greatest(1, floor(0.75 * k)) ELSE least(3, ceil(1.25 * k)) END::INT AS by_factor, CASE WHEN eff < 0.1 THEN greatest(1, k - 1) ELSE least(3, k + 1) END::INT AS by_one,
CASE WHEN far < 0.1 THEN greatest(1, k - 1) ELSE least(3, k + 1) END::INT AS by_one_cumulative FROM sc""")
def scaling_naive(spark, sf_dir):
    """By the last step's efficiency and by the cumulative one."""
    per = _rounds(spark, sf_dir).where("played").groupBy("round").agg(F.avg("reward").alias("eff"), F.avg(F.col("sum") / F.col("cnt")).alias("far"), F.count("*").alias("k"))
    one = lambda e: monitor.naive_scaling_2(F.col(e), F.col("k"), 0.1, 1, 3)
    return per.select("round", monitor.naive_scaling_1(F.col("eff"), F.col("k"), 0.1, 0.25, 1, 3).alias("by_factor"), one("eff").alias("by_one"), one("far").alias("by_one_cumulative"))


def _kl_sql(plus: bool) -> str:
    log = "ln(greatest(t / cnt, 1))" if plus else "ln(greatest(t, 1))"
    return f"""WITH RECURSIVE {STREAM}, {ROUNDS},
h AS (SELECT round, arm, greatest(total / cnt, 1e-8) AS p, {log} / cnt AS bonus, greatest(total / cnt, 1e-8) AS near, (1 - 1e-8)::DOUBLE AS far, 0 AS i FROM ro
  UNION ALL SELECT round, arm, p, bonus, CASE WHEN fits THEN q ELSE near END, CASE WHEN fits THEN far ELSE q END, i + 1 FROM
    (SELECT *, p * ln(p / q) + (1 - p) * ln((1 - p) / (1 - q)) <= bonus AS fits FROM (SELECT *, (near + far) / 2 AS q FROM h WHERE i < 60 AND p < 1))),
b AS (SELECT round, arm, CASE WHEN p >= 1 THEN 1 ELSE near END AS b FROM h WHERE i = 60 OR p >= 1),
ix AS (SELECT round, list(b ORDER BY b DESC) AS b FROM b GROUP BY round), ef AS (SELECT round, avg(total / cnt) AS eff, count(*) AS k FROM ro WHERE played GROUP BY round)
SELECT round, k, (CASE WHEN eff <= 0.1 THEN greatest(least(1, k), k - 1) WHEN k < 3 AND k / (k + 1) * eff + coalesce(b[k + 1], 0) / (k + 1) > 0.1 THEN k + 1 ELSE k END)::INT AS next_k FROM ef JOIN ix USING (round)"""


@query(_kl_sql(False))
def scaling_kl(spark, sf_dir):
    return monitor.kl_scaling(_rounds(spark, sf_dir), 0.1, 1, 3)


@query(_kl_sql(True))
def scaling_kl_plus(spark, sf_dir):
    return monitor.kl_scaling(_rounds(spark, sf_dir), 0.1, 1, 3, True)


def _bandit(name: str):
    def run(spark, sf_dir):
        scaling = policies.Scaling("kl", 2, 0.3)
        return policies.run_policies(gains(spark, sf_dir).select("t", "arm", "value"), [name], 2, scaling=scaling, parameter=50 if name == "mpswucb" else 0.9)

    run.__name__ = f"bandit_{name}"
    return run


#: The index by which an arm is chosen, from what it gained (s), how often it
#: was pulled (c), the step (t) and its reward (x), where nothing is drawn.
_BEST = {
    "cucb": "s / c + sqrt(1.5 * ln(t) / c)",
    "cucbm": "s / c + sqrt(0.5 * ln(t) / c)",
    "mpducb": "CASE WHEN t >= 1 THEN s / c + sqrt(1.5 * ln(t) / c) ELSE s / c END",
    "mpklucb": "kl_index(s, c, t)",
    "mpklucbplus": "kl_index(s, c, t / c)",
    "dynamic": "x",
    "worst": "-x",
    "static": "all_x",
    "sequential": "-((a - pulled) % 3 + 3) % 3",
}


def _kl_index(s: str, c: str, log_of: str) -> str:
    """The halving as a fold: a step goes ahead by half the width where that fits."""
    p, q = f"greatest({s} / {c}, 1e-8)", "(near + width)"
    fits = f"{p} * ln({p} / {q}) + (1 - {p}) * ln((1 - {p}) / (1 - {q})) <= ln(greatest({log_of}, 1)) / {c}"
    halves = f"[(1 - 1e-8 - {p}) / pow(2, i) FOR i IN range(1, 61)]"
    return f"CASE WHEN {p} >= 1 THEN 1 ELSE list_reduce(list_concat([{p}], {halves}), lambda near, width: CASE WHEN {fits} THEN {q} ELSE near END) END"


def _policy_sql(name: str) -> str:
    """A policy without draws, step by step: sums and counts of three arms as lists."""
    index = _BEST[name]
    if name.startswith("mpklucb"):
        index = _kl_index("s", "c", "t / c" if name.endswith("plus") else "t")
    after = "0.9 * t + 1" if name == "mpducb" else "t + 1"
    return f"""WITH RECURSIVE {STREAM}, x AS (SELECT t AS step, list(reward ORDER BY arm) AS xs FROM g GROUP BY t),
al AS (SELECT list(total ORDER BY arm) AS alls FROM (SELECT arm, sum(reward) AS total FROM g GROUP BY arm)),
run AS (SELECT -1::BIGINT AS step, 2::BIGINT AS k, 1::DOUBLE AS t, [1, 1, 1]::DOUBLE[] AS ss, [1, 1, 1]::DOUBLE[] AS cs, 0::BIGINT AS pulled,
    []::INT[] AS arms, []::DOUBLE[] AS gains, 0::BIGINT AS pulls
  UNION ALL SELECT step, CASE WHEN eff <= 0.3 THEN greatest(least(1, pulls), pulls - 1) WHEN pulls >= 3 THEN pulls
      WHEN pulls / (pulls + 1) * eff + list_reverse_sort([{_kl_index('s2[i]', 'c2[i]', 'greatest(t2, 1)')} FOR i IN [1, 2, 3]])[pulls + 1] / (pulls + 1) > 0.3 THEN pulls + 1 ELSE pulls END,
    t2, s2, c2, pulled + pulls, picked, gains, pulls FROM
    (SELECT *, list_avg([s2[a + 1] / c2[a + 1] FOR a IN picked]) AS eff, {after} AS t2, [xs[a + 1] FOR a IN picked] AS gains FROM
      (SELECT *, [ss[a + 1] + CASE WHEN list_contains(picked, a) THEN xs[a + 1] ELSE 0 END FOR a IN [0, 1, 2]] AS s2, [cs[a + 1] + list_contains(picked, a)::INT FOR a IN [0, 1, 2]] AS c2 FROM
        (SELECT step, t, ss, cs, xs, pulled, k AS pulls, ([o.a FOR o IN list_sort([{{'i': -o.i, 'a': o.a}} FOR o IN ix])])[1:k] AS picked FROM
          (SELECT x.step, k, t, ss, cs, xs, pulled, [{{'i': ({re.sub(r"[a-z_]+", lambda m: _PER_ARM.get(m.group(), m.group()), index)})::DOUBLE, 'a': a}} FOR a IN [0, 1, 2]] AS ix
           FROM run JOIN x ON x.step = run.step + 1, al)))))
SELECT '{name}' AS policy, rep::INT AS rep, step::INT AS t, arms, gains, list_sum(gains) AS gain, pulls::INT AS k FROM run, (SELECT unnest([0, 1]) AS rep) WHERE step >= 0"""


_PER_ARM = {"s": "ss[a + 1]", "c": "cs[a + 1]", "x": "xs[a + 1]", "all_x": "alls[a + 1]"}

for _name in (*policies.POLICIES, *policies.ADAPTIVE):
    query(_policy_sql(_name) if _name in _BEST else None)(_bandit(_name))


@query()
def adwin_width(spark, sf_dir):
    """The adaptive window's width after each event, by event type."""
    import pandas as pd

    from ..streaming.adwin import Adwin

    def one(frame):
        w, out = Adwin(0.1), []
        for i, x in frame.sort_values("event_id")[["event_id", "value"]].itertuples(index=False):
            cut = w.add(float(x))
            out.append((frame["event_type"].iloc[0], i, w.width, round(w.mean, 6), cut))
        return pd.DataFrame(out, columns=["event_type", "event_id", "width", "mean", "cut"])

    e = table(spark, sf_dir, "events").select("event_type", "event_id", "value")
    return e.groupBy("event_type").applyInPandas(one, "event_type string, event_id long, width long, mean double, cut boolean")


# -- quality of rankings -----------------------------------------------------------------------------------------------


@query(f"WITH {RANKING} SELECT place, round(fp / (n - p), 9) AS fpr, round(tp / p, 9) AS tpr FROM o, t")
def roc_curve(spark, sf_dir):
    return metrics.roc_curve(ranking(spark, sf_dir)).select("place", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


@query(f"WITH {RANKING} SELECT round(sum(CASE WHEN y = 0 THEN tp ELSE 0 END) / max(p * (n - p)), 9) AS roc_auc FROM o, t")
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(ranking(spark, sf_dir)).select(F.round("roc_auc", 9).alias("roc_auc"))


PR = f"""{RANKING}, th AS (SELECT score, sum(y) AS own, count(*) AS k FROM l GROUP BY score),
pr AS (SELECT score, own, sum(own) OVER (ORDER BY score DESC) AS tp, sum(k) OVER (ORDER BY score DESC) AS upto FROM th)"""


@query(f"WITH {PR} SELECT score AS threshold, round(tp / upto, 9) AS precision, round(tp / p, 9) AS recall FROM pr, t UNION ALL SELECT NULL, 1, 0")
def pr_curve(spark, sf_dir):
    return metrics.pr_curve(ranking(spark, sf_dir)).select("threshold", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query(f"WITH {PR} SELECT round(sum(own / p * tp / upto), 6) AS pr_auc FROM pr, t")
def pr_auc(spark, sf_dir):
    return metrics.pr_auc(ranking(spark, sf_dir)).select(F.round("pr_auc", 6).alias("pr_auc"))


@query(f"WITH {RANKING} SELECT round(sum(CASE WHEN y = 1 THEN tp / (place + 1) ELSE 0 END) / max(p), 6) AS average_precision FROM o, t")
def average_precision(spark, sf_dir):
    return metrics.average_precision(ranking(spark, sf_dir)).select(F.round("average_precision", 6).alias("average_precision"))


@query(f"""WITH {RANKING}, c AS (SELECT unnest([1, 2, 5, 10, 20, 30]) AS percent), h AS (SELECT percent, floor(n / 100 * percent) AS top, coalesce(sum(y) FILTER (place < floor(n / 100 * percent)), 0) AS tp, max(p) AS p FROM c, t, o GROUP BY percent, n)
SELECT percent, round(CASE WHEN tp > 0 THEN tp / p ELSE 0 END, 9) AS recall, round(CASE WHEN tp > 0 THEN tp / top ELSE 0 END, 9) AS precision FROM h""")
def precision_recall_at(spark, sf_dir):
    return metrics.precision_recall_at(ranking(spark, sf_dir)).select("percent", F.round("recall", 9).alias("recall"), F.round("precision", 9).alias("precision"))


_AT = ", ".join(f"(SELECT coalesce(sum(y) FILTER (place < floor(n / 100 * {k})), 0) FROM o, t GROUP BY n) AS h{k}" for k in (1, 2, 5, 10, 20, 30))
_AT_SQL = ", ".join(f"CASE WHEN h{k} > 0 THEN h{k} / floor(n / 100 * {k}) ELSE 0 END AS p{k}, CASE WHEN h{k} > 0 THEN h{k} / p ELSE 0 END AS r{k}" for k in (1, 2, 5, 10, 20, 30))


@query(f"""WITH {PR}, hit AS (SELECT {_AT}), a AS (SELECT sum(CASE WHEN y = 0 THEN tp ELSE 0 END) / max(p * (n - p)) AS roc_auc, sum(CASE WHEN y = 1 THEN tp / (place + 1) ELSE 0 END) / max(p) AS average_precision FROM o, t),
b AS (SELECT sum(own / p * tp / upto) AS pr_auc FROM pr, t), s AS (SELECT roc_auc, pr_auc, average_precision, {_AT_SQL} FROM a, b, hit, t)
SELECT round(COLUMNS(*), 6) FROM s""")
def evaluation_summary(spark, sf_dir):
    out = metrics.evaluate(ranking(spark, sf_dir))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


# -- reports -----------------------------------------------------------------------------------------------------------------


def _runs(spark, sf_dir) -> DataFrame:
    """Events as results of runs: an id, counts, lists of columns."""
    e = dataset.numbered(table(spark, sf_dir, "events"), "event_id", "i")
    ident = F.concat_ws("-", F.lit("ksp"), F.lit("0.9"), F.col("event_type"), F.pmod("user_id", F.lit(3)).cast("string"), F.lit("100"))
    return e.select("i", ident.alias("run"), "event_type", F.pmod("user_id", F.lit(3)).alias("width"), F.pmod("user_id", F.lit(7)).alias("tried"), F.pmod("user_id", F.lit(4)).alias("success"), "value", F.when(F.pmod("user_id", F.lit(5)) == 0, F.lit(None).cast("string")).otherwise(F.concat_ws(",", F.pmod("user_id", F.lit(6)).cast("string"), F.pmod("user_id", F.lit(9)).cast("string"))).alias("searched"))


RUNS = """runs AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, 'ksp-0.9-' || event_type || '-' || user_id % 3 || '-100' AS run, event_type, user_id % 3 AS width, user_id % 7 AS tried, user_id % 4 AS success, value,
  CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id % 6 || ',' || user_id % 9 END AS searched FROM events)"""


@query(f"""WITH {RUNS} SELECT i, split_part(run, '-', 3) AS strategy, split_part(run, '-', 4) AS width, split_part(run, '-', -1) AS rows_kept,
CASE WHEN contains(run, 'click') THEN split_part(run, '-', 4) ELSE split_part(run, '-', 3) END AS chosen, CASE WHEN tried > 0 THEN round(success / tried, 9) ELSE 0 END AS ratio,
CASE WHEN searched IS NULL THEN 0 ELSE 2 END AS n_searched, CASE WHEN contains(run, 'click') THEN 'A' WHEN contains(run, 'view') THEN 'B' ELSE 'other' END AS class,
CASE event_type WHEN 'click' THEN 'Click!' ELSE event_type END AS label, success + tried AS total FROM runs""")
def report_ids(spark, sf_dir):
    r = _runs(spark, sf_dir)
    run = F.col("run")
    return r.select(
        "i", report.part_of_id(run, 3).alias("strategy"), report.part_of_id(run, 4).alias("width"), report.part_of_id(run, -1).alias("rows_kept"),
        report.conditional_part(run, "click", 4, 3).alias("chosen"), F.round(report.success_ratio(F.col("success"), F.col("tried")), 9).alias("ratio"),
        report.token_number(F.col("searched")).alias("n_searched"), report.classify(run, [("click", "A"), ("view", "B")], "other").alias("class"),
        report.relabel(F.col("event_type"), {"click": "Click!"}).alias("label"), (F.col("success") + F.col("tried")).alias("total"),
    )


@query(f"WITH {RUNS} SELECT event_type, width, round(avg(value), 9) AS mean FROM runs WHERE value <> 0 GROUP BY event_type, width")
def group_mean(spark, sf_dir):
    out = report.group_mean(_runs(spark, sf_dir), ["event_type", "width"], "value", nonzero=True)
    return out.withColumn("mean", F.round("mean", 9))


@query(f"WITH {RUNS} SELECT event_type, i, run, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, i) AS k FROM runs) WHERE k = 1")
def argmax_row_per_group(spark, sf_dir):
    return report.best_row(_runs(spark, sf_dir).select("event_type", "i", "run", "value"), ["event_type"], "value", "i")


@query(f"WITH {RUNS} SELECT i, event_type, round(avg(value) OVER (PARTITION BY event_type ORDER BY i ROWS 99 PRECEDING), 9) AS mean FROM runs")
def rolling_mean_100(spark, sf_dir):
    out = report.rolling_mean(_runs(spark, sf_dir), ["event_type"], "i", "value")
    return out.select("i", "event_type", F.round("mean", 9).alias("mean"))


@query(f"""WITH {RUNS}, n AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY i) AS step FROM runs), gold AS (SELECT step, max(value) AS gold FROM n GROUP BY step)
SELECT event_type, step, round(sum(gold - value) OVER (PARTITION BY event_type ORDER BY step ROWS UNBOUNDED PRECEDING), 4) AS regret FROM n JOIN gold USING (step)""")
def cumulative_regret(spark, sf_dir):
    n = _runs(spark, sf_dir).select("event_type", "value", F.row_number().over(W.partitionBy("event_type").orderBy("i")).alias("step"))
    best = n.groupBy("step").agg(F.max("value").alias("value"))
    return report.cumulative_regret(n, best, ["event_type"], "step", "value").select("event_type", "step", F.round("regret", 4).alias("regret"))


@query(f"WITH {RUNS}, x AS (SELECT event_type, unnest(string_split(searched, ',')) AS token FROM runs WHERE searched IS NOT NULL) SELECT event_type, token, round(count(*) / 9000, 9) AS frequency FROM x GROUP BY ALL")
def search_frequency(spark, sf_dir):
    return report.search_frequency(_runs(spark, sf_dir), ["event_type"], "searched", 9000.0).withColumn("frequency", F.round("frequency", 9))


@query(f"WITH {RUNS} SELECT i, value FROM runs WHERE i % 10 = 0")
def every_tenth_row(spark, sf_dir):
    """A sampling operator: every tenth row is what it gives."""
    return report.every_nth(_runs(spark, sf_dir), "i", 10).select("i", "value")


@query("""WITH w AS (SELECT n_name AS data, count(*) AS orders, sum(o_totalprice)::DOUBLE AS spent FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name)
SELECT data, 'orders' AS method, round(orders / 1000, 4) AS seconds FROM w UNION ALL SELECT data, 'spent', round(spent / 1000, 4) FROM w""")
def wide_to_long(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    w = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey).groupBy(F.col("n_name").alias("data")).agg(F.count("*").cast("double").alias("orders"), F.sum("o_totalprice").alias("spent"))
    return report.long_runtimes(w, "data").withColumn("seconds", F.round("seconds", 4))


@query(f"WITH {RUNS} SELECT DISTINCT width FROM runs UNION ALL SELECT DISTINCT tried FROM runs")
def union_distinct(spark, sf_dir):
    r = _runs(spark, sf_dir)
    return report.union_runs(r.select("width").distinct(), r.select(F.col("tried").alias("width")).distinct())


@query()
def decay_fit(spark, sf_dir):
    """y = a + b x^-c of mean values against the number of searches tried."""
    r = _runs(spark, sf_dir).groupBy("event_type", (F.col("tried") + 1).alias("x")).agg(F.avg("value").alias("y"))
    return report.fit_decay(r, "event_type", "x", "y")
