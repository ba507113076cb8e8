"""DuckDB statements of the results that SQL can express."""

OP4 = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS draw
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w,
         2 * source_size AS cap, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS total FROM s),
o AS (
  SELECT *, total - (sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING) - cap) AS rest,
         sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM w),
l AS (SELECT *, cap / w <= rest / ws AS clamped, rest / ws AS level FROM o),
t AS (
  SELECT source, source_size,
         CASE WHEN clamped THEN CAST(cap AS DOUBLE) ELSE max(CASE WHEN NOT clamped THEN level END) OVER () * w END AS target FROM l),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
q AS (
  SELECT d.doc_id, d.size, d.draw, p.source_size, p.target, p.whole,
         CAST(round(p.target) AS BIGINT) - p.whole * p.source_size AS part,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw RANGE UNBOUNDED PRECEDING) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.draw) AS here,
         count(*) OVER (PARTITION BY d.source, d.draw) AS same
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + CASE WHEN size = 0 OR upto - here > part THEN 0
            WHEN upto <= part THEN size
            ELSE least(size, (part - (upto - here)) // same) END AS BIGINT) AS taken
FROM q
"""

OP10 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS n_all,
         sum(length('<|im_start|>') + 1 + length('<|im_end|>') + 1
           + length(replace(replace(replace(replace(role, '\', '\\'), '<', '\u003c'), '[', '\u005b'), chr(10), '\u000a'))
           + length(replace(replace(replace(text, '\', '\\'), '<', '\u003c'), '[', '\u005b'))) OVER (w ROWS UNBOUNDED PRECEDING) AS upto
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR n = n_all) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

OP13 = r"""
WITH c AS (SELECT list(x ORDER BY i) AS crc FROM (
  SELECT i, list_reduce([i] || range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END) AS x FROM (SELECT unnest(range(256)) AS i))),
x AS (
  SELECT 'd' AS side, doc_id, row_number() OVER () AS n, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 't', NULL, -row_number() OVER (), regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
e AS (SELECT side, n, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM x),
k AS (SELECT f, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 't') AS t FROM e GROUP BY f),
h AS (
  SELECT f, s, t, xor(list_reduce([4294967295::BIGINT] || list_transform(range(0, length(hex(encode(f))), 2), lambda i: CAST('0x' || substr(hex(encode(f)), i + 1, 2) AS BIGINT)),
    lambda a, b: xor(a >> 8, crc[1 + (xor(a, b) & 255)])), 4294967295) % 10000 AS bucket FROM k, c),
b AS (SELECT bucket, sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM h GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain FROM b),
m AS (SELECT n, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS total FROM e JOIN h USING (f) JOIN g USING (bucket) WHERE side = 'd' GROUP BY n),
y AS (
  SELECT doc_id, n, len(w) AS words, coalesce(n_features, 0) AS n_features,
         coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS weight,
         CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS noise
  FROM x LEFT JOIN m USING (n) WHERE side = 'd'),
z AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY weight + noise DESC, doc_id NULLS LAST) AS place, count(*) FILTER (words >= 20) OVER () * 25 // 100 AS most FROM y)
SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight, CAST(weight + noise AS BIGINT) AS score, CASE WHEN words >= 20 AND place <= most THEN place END AS rank FROM z
"""



def _lloyd() -> str:
    """Rounds of plain Lloyd: every vector against every centroid."""
    far = "list_sum(list_transform(range(1, 65), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i])))"
    steps = []
    for k in range(4):
        steps.append(f"""a{k} AS (SELECT n, vec_id, v, best[2] AS k, best[1] AS d FROM (
  SELECT x.n, any_value(x.vec_id) AS vec_id, any_value(x.v) AS v, min([CAST({far} AS BIGINT), c.k]) AS best FROM x, c{k} AS c GROUP BY x.n))""")
        steps.append(f"""s{k} AS (SELECT k, i, sum(v[i])::BIGINT AS s, count(*) AS m FROM a{k}, (SELECT unnest(range(1, 65)) AS i) GROUP BY k, i),
m{k} AS (SELECT k, list((s - ((s % m) + m) % m) // m ORDER BY i) AS v FROM s{k} GROUP BY k),
c{k + 1} AS (SELECT c.k, coalesce(m.v, c.v) AS v FROM c{k} AS c LEFT JOIN m{k} AS m USING (k))""")
    return f"""WITH x AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v FROM (SELECT v, sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h FROM x ORDER BY h, v LIMIT 16)),
{", ".join(steps[:-1])},
t AS (SELECT k, sum(d)::BIGINT AS own FROM a3 GROUP BY k)
SELECT vec_id, CAST(a3.k AS INTEGER) AS cluster, d AS distance, own AS cluster_inertia, CAST((SELECT sum(own) FROM t) AS BIGINT) AS inertia,
       sha256(array_to_string(c3.v, ',')) AS centroid_sha256
FROM a3 JOIN t USING (k) JOIN c3 USING (k)"""


OP12 = _lloyd()

ORACLES = {"op12_delta_lloyd": OP12, "op13_importance_dictionary": OP13, "op4_mix_water_filling": OP4, "op10_chat_prefix_targets": OP10}
