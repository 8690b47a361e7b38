"""SQL over all pairs or all positions, for small tables."""

#: Every 100-byte string of every document, as hexadecimal digits.
OP1_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 99, 0))) AS i FROM d)),
m AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
g AS (SELECT doc_id, i, sum(CASE WHEN i - before <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run
  FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM m)),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY doc_id, run),
k AS (SELECT *, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS since FROM r),
s AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS kept
  FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN last IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN s USING (doc_id)
"""

#: Every window of 50 words.
OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 50], ' ') AS s FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 49, 0))) AS i FROM d)),
m AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM x) WHERE doc_id > first),
g AS (SELECT doc_id, i, sum(CASE WHEN i - before <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run
  FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM m)),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, run),
k AS (SELECT *, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS since FROM r),
s AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, max(b) AS last, string_agg(CASE WHEN a > since THEN array_to_string(w[since + 1:a], ' ') END, ' ' ORDER BY a) AS kept
  FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed,
  sha256(concat_ws(' ', kept, CASE WHEN len(w) > coalesce(last, 0) THEN array_to_string(w[coalesce(last, 0) + 1:], ' ') END)) AS kept_sha256
FROM d LEFT JOIN s USING (doc_id)
"""

#: All pairs that share a shingle; components by reachability.
OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i + 1:i + 5], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) = 0 THEN 0 ELSE greatest(len(w) - 4, 1) END)) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 85 * (a.n + b.n - common)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT x AS doc_id, y AS other FROM e UNION SELECT r.doc_id, e.y FROM reach r JOIN e ON e.x = r.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) AS component_id, d.doc_id <= coalesce(c.least, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS least FROM reach GROUP BY doc_id) c USING (doc_id)
"""

#: The least capacity by halving: a fold over seven shards fills greedily from
#: the list of running sums. CRC-32 goes byte by byte through its table.
OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, text AS given FROM documents),
tb AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda a, b: xor(a >> 1, (a & 1) * 3988292384)) ORDER BY n) AS t FROM range(0, 256) r(n)),
hx AS (SELECT DISTINCT text, hex(encode(text)) AS h FROM d),
cr AS (SELECT text, length(h) // 2 AS n, xor(list_reduce(list_concat([4294967295]::BIGINT[], [('0x' || substr(h, 2 * i + 1, 2))::BIGINT FOR i IN range(0, length(h) // 2)]),
  lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS crc FROM hx, tb),
k AS (SELECT doc_id, given, text, n + 1 AS size, crc, row_number() OVER (ORDER BY doc_id NULLS FIRST, given NULLS FIRST) AS rid FROM d JOIN cr USING (text)),
g AS (SELECT text, min(rid) AS first, sum(size)::BIGINT AS size FROM k GROUP BY text),
o AS (SELECT *, (sum(size) OVER (ORDER BY first))::BIGINT AS upto FROM g),
u AS (SELECT list(upto ORDER BY upto) AS ends, max(upto) AS total, max(size) AS most FROM o),
b AS (SELECT greatest((total + 7) // 8, most) AS lo, (total + 7) // 8 + most AS hi FROM u
  UNION ALL SELECT CASE WHEN fits THEN lo ELSE mid + 1 END, CASE WHEN fits THEN mid ELSE hi END FROM
    (SELECT lo, hi, mid, list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda done, i: list_max([0] || [x FOR x IN ends IF x <= done + mid])) + mid >= total AS fits
     FROM (SELECT lo, hi, (lo + hi) // 2 AS mid FROM b WHERE lo < hi), u)),
c AS (SELECT lo AS capacity FROM b WHERE lo = hi),
cuts AS (SELECT DISTINCT list_reduce(list_concat([0]::BIGINT[], range(0, j)), lambda done, i: list_max([0] || [x FOR x IN ends IF x <= done + capacity])) AS cut, total FROM c, u, range(1, 8) r(j)),
p AS (SELECT text, first, (SELECT count(*) FROM cuts WHERE cut < total AND cut <= upto - size)::INT AS shard FROM o)
SELECT doc_id, k.size, crc AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY first, rid) - 1 AS slot, NULL::INT AS grown_shard FROM k JOIN p USING (text)
"""

_TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+')"
_QUESTION = r"CASE WHEN marked <> '' THEN regexp_replace(marked, '(?is)\n\s*(?:answer|a)\s*:$', '') ELSE substr(text, 1, cut) END"
_SHINGLES = "[array_to_string({0}[i:i + {1} - 1], ' ') FOR i IN range(1, len({0}) - {1} + 2)]"
_K = "CASE WHEN len({0}) >= 10 THEN 5 ELSE greatest(1, least(3, len({0}))) END"
_SHARE = "CASE WHEN len({0}) = 0 THEN 1.0 ELSE len(list_filter({0}, lambda x: list_contains({1}, x))) / len({0}) END::DOUBLE"

#: Scores of all passages and items. An item is cut at its answer mark, before
#: its last sentences with a quarter of its words, or before those words.
OP6_SQL = rf"""
WITH i AS (SELECT row_number() OVER () AS nr, item_id, coalesce(text, '') AS text FROM benchmark),
iw AS (SELECT *, {_TERMS.format("text")} AS w, greatest(1, len(regexp_extract_all(text, '\S+')) // 4) AS least FROM i),
cn AS (SELECT count(*) AS items, sum(len(w))::DOUBLE AS terms, max(len(w)) AS longest, greatest(16, max(len(w)) // 2) AS stride FROM iw),
tf AS (SELECT nr, t, count(*) AS tf, any_value(n) AS n FROM (SELECT nr, len(w) AS n, unnest(w) AS t FROM iw) GROUP BY nr, t),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
wt AS (SELECT nr, t, ln(1 + (items - df + 0.5) / (df + 0.5)::DOUBLE) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25 + 0.75 * n / (terms / items))) AS weight FROM tf JOIN df USING (t), cn),
ow AS (SELECT nr, sum(weight) / 2 AS enough FROM wt GROUP BY nr),
mk AS (SELECT *, regexp_extract(text, '(?is)^.*?\n\s*(?:answer|a)\s*:') AS marked, regexp_extract_all(text, '(?s).*?[.!?]\s+') AS sentences, regexp_extract_all(text, '(?s)\s*\S+') AS words FROM iw),
se AS (SELECT *, list_max([e.at FOR e IN [{{'at': list_sum([length(x) FOR x IN sentences[1:j]])::BIGINT, 'j': j}} FOR j IN range(1, len(sentences) + 1)]
  IF e.at < length(text) AND (e.j > 1 OR regexp_matches(regexp_replace(sentences[1], '[.!?]\s+$', ''), '\S')) AND len(regexp_extract_all(substr(text, e.at + 1), '\S+')) >= least]) AS at_sentence FROM mk),
cu AS (SELECT *, CASE WHEN marked <> '' THEN length(marked) ELSE coalesce(at_sentence, CASE WHEN len(words) > least THEN length(array_to_string(words[1:len(words) - least], '')) ELSE length(text) END) END AS cut FROM se),
qa AS (SELECT nr, item_id, {_TERMS.format(_QUESTION)} AS q, {_TERMS.format("substr(text, cut + 1)")} AS a FROM cu),
qk AS (SELECT *, {_K.format("q")} AS qk, {_K.format("a")} AS ak FROM qa),
sh AS (SELECT nr, item_id, qk, ak, list_distinct({_SHINGLES.format("q", "qk")}) AS qs, list_distinct({_SHINGLES.format("a", "ak")}) AS "as" FROM qk),
dw AS (SELECT doc_id, {_TERMS.format("coalesce(text, '')")} AS w FROM documents),
ps AS (SELECT doc_id, w, longest, stride, unnest(range(0, CASE WHEN len(w) = 0 THEN 0 ELSE greatest(1, ceil((len(w) - longest - stride) / stride)::BIGINT + 1) END)) * stride AS start FROM dw, cn),
pt AS (SELECT DISTINCT doc_id, start, t FROM (SELECT doc_id, start, unnest(w[start + 1:start + longest + stride]) AS t FROM ps)),
sc AS (SELECT doc_id, start, nr, sum(weight) AS score FROM pt JOIN wt USING (t) GROUP BY doc_id, start, nr),
rt AS (SELECT doc_id, start, nr, score, w[greatest(0, start - longest) + 1:start + longest + stride + longest] AS region FROM sc JOIN ow USING (nr) JOIN ps USING (doc_id, start) WHERE score >= enough * (1 - 1e-9::DOUBLE)),
rs AS (SELECT rt.*, item_id, qs, "as", {_SHINGLES.format("region", "qk")} AS rq, {_SHINGLES.format("region", "ak")} AS ra FROM rt JOIN sh USING (nr)),
ov AS (SELECT *, {_SHARE.format("qs", "rq")} AS question_overlap, {_SHARE.format('"as"', "ra")} AS answer_overlap FROM rs)
SELECT doc_id, item_id, start AS passage, round(score, 6) AS score, round(question_overlap, 6) AS question_overlap, round(answer_overlap, 6) AS answer_overlap
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, nr ORDER BY round(score, 9) DESC, start) AS best FROM ov WHERE least(question_overlap, answer_overlap) >= 0.7) WHERE best = 1
"""
