"""DuckDB statements of the registered queries, over the fixture tables."""

from __future__ import annotations

_RUNS = r"regexp_extract_all({x}, '[A-Za-z][A-Za-z0-9]*|\p{{Nd}}+|[\x{{4e00}}-\x{{9fff}}]+')"


def tokens(x: str) -> str:
    """The tokeniser as a list expression over the text expression ``x``."""
    cased = r"string_split(lower(regexp_replace(regexp_replace(r, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g')), ' ')"
    chars = "list_transform(range(1, length(r) + 1), lambda i: substr(r, i, 1))"
    pairs = "list_transform(range(1, length(r)), lambda i: substr(r, i, 2))"
    wide = f"CASE WHEN length(r) > 2 THEN [r] || {chars} || {pairs} WHEN length(r) > 1 THEN [r] || {chars} ELSE [r] END"
    return f"flatten(list_transform({_RUNS.format(x=x)}, lambda r: CASE WHEN ascii(r) < 128 THEN {cased} ELSE {wide} END))"


_DOCS = f"docs AS (SELECT CAST(doc_id AS VARCHAR) AS uid, source AS file, text AS document, {tokens("concat_ws(' ', coalesce(source, ''), text)")} AS tokens FROM documents)"

TOKEN_STATS = f"WITH {_DOCS} SELECT uid, CAST(len(tokens) AS BIGINT) AS n_tokens, CAST(len(list_distinct(tokens)) AS BIGINT) AS n_distinct FROM docs"
DOCUMENT_FREQUENCY = f"WITH {_DOCS} SELECT tok, count(*) AS df FROM (SELECT unnest(list_distinct(tokens)) AS tok FROM docs) GROUP BY tok"
CORPUS_STATS = f"WITH {_DOCS} SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM docs"


def _bm25(limit: int) -> str:
    return f"""{_DOCS},
q AS (SELECT item_id AS query_id, tok, count(*) AS qtf FROM (SELECT item_id, unnest({tokens("coalesce(text, '')")}) AS tok FROM benchmark WHERE trim(coalesce(text, '')) <> '') GROUP BY ALL),
tf AS (SELECT uid, dl, tok, count(*) AS tf FROM (SELECT uid, len(tokens) AS dl, unnest(tokens) AS tok FROM docs) WHERE tok IN (SELECT tok FROM q) GROUP BY ALL),
df AS (SELECT tok, count(*) AS df FROM tf GROUP BY tok),
st AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM docs),
sc AS (SELECT query_id, uid, round(sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE
        / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
       FROM q JOIN tf USING (tok) JOIN df USING (tok), st GROUP BY query_id, uid),
bm AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, uid) AS INTEGER) AS bm25_rank FROM sc WHERE score > 0) WHERE bm25_rank <= {limit})"""


def _vector(limit: int, queries: str) -> str:
    return f"""vq AS ({queries}),
vs AS (SELECT query_id, CAST(vec_id AS VARCHAR) AS uid,
         round(-list_sum(list_transform(list_zip(e.embedding, vq.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))), 6) + 0.0 AS score
       FROM embeddings e, vq),
ve AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, uid) AS INTEGER) AS vector_rank FROM vs) WHERE vector_rank <= {limit})"""


_BY_ITEM = "SELECT item_id AS query_id, embedding FROM benchmark JOIN embeddings ON item_id = vec_id WHERE trim(coalesce(text, '')) <> ''"
BM25_TOPK = f"WITH {_bm25(10)} SELECT * FROM bm"
VECTOR_TOPK = f"WITH {_vector(10, 'SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 100 = 0')} SELECT * FROM ve"
VECTOR_BLOCKS = f"WITH {_vector(3, 'SELECT vec_id AS query_id, embedding FROM embeddings')} SELECT * FROM ve"


def _hybrid(limit: int = 10) -> str:
    return f"""{_bm25(30)}, {_vector(30, _BY_ITEM)},
fused AS (SELECT coalesce(ve.query_id, bm.query_id) AS query_id, coalesce(ve.uid, bm.uid) AS uid, vector_rank, bm25_rank,
            round(coalesce(1.0::DOUBLE / (60.0::DOUBLE + vector_rank), 0) + coalesce(1.0::DOUBLE / (60.0::DOUBLE + bm25_rank), 0), 9) AS score
          FROM ve FULL JOIN bm ON ve.query_id = bm.query_id AND ve.uid = bm.uid),
hy AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, uid) AS INTEGER) AS rank FROM fused) WHERE rank <= {limit})"""


RRF_HYBRID = f"WITH {_hybrid()} SELECT query_id, uid, score, vector_rank, bm25_rank, rank FROM hy"
HIT_LINES = f"""WITH {_hybrid()}
SELECT query_id, rank, coalesce(file, '') || ':0 (' || concat_ws(', ', printf('RRF:%.4f', score), 'vector#' || vector_rank, 'BM25#' || bm25_rank) || ') | '
       || replace(coalesce(substr(document, 1, 150), ''), chr(10), ' ') AS line
FROM hy LEFT JOIN docs USING (uid)"""
SEARCH_REPORT = f"""WITH {_bm25(10)},
ln AS (SELECT query_id, bm25_rank AS r, coalesce(file, '') || ':' || (CAST(uid AS BIGINT) % 90) || ' (BM25#' || bm25_rank || ') | ' || replace(coalesce(substr(document, 1, 150), ''), chr(10), ' ') AS line
  FROM bm LEFT JOIN docs USING (uid) WHERE query_id % 10 <> 0),
p AS (SELECT query_id, count(*) || ' results:' || string_agg(chr(10) || '  ' || line, '' ORDER BY r) AS found FROM ln GROUP BY query_id)
SELECT item_id AS query_id, coalesce(found, 'no results for ' || chr(39) || CASE WHEN item_id % 10 = 0 THEN 'zzzzqqqq qqqqzzzz' ELSE coalesce(text, '') END || chr(39)) AS report
FROM benchmark LEFT JOIN p ON item_id = query_id"""
RETRIEVAL_EVAL = f"""WITH {_hybrid()},
items AS (SELECT item_id AS query_id, ['src' || (item_id % 20), CAST(item_id AS VARCHAR)] AS relevant FROM benchmark WHERE trim(coalesce(text, '')) <> ''),
v10 AS (SELECT query_id, uid, vector_rank AS rank FROM ve WHERE vector_rank <= 10),
hits AS (SELECT 'vector' AS mode, query_id, uid, rank FROM v10 UNION ALL SELECT 'hybrid', query_id, uid, rank FROM hy),
met AS (SELECT mode, h.query_id, count(DISTINCT label) AS met, min(rank) AS first
        FROM (SELECT h.*, file FROM hits h LEFT JOIN docs USING (uid)) h
        JOIN (SELECT query_id, unnest(relevant) AS label FROM items) w ON h.query_id = w.query_id AND (h.uid = label OR h.file = label) GROUP BY ALL)
SELECT mode, count(*) AS n_queries, round(avg(coalesce(met, 0)::DOUBLE / len(relevant)), 9) AS recall, round(avg(coalesce(1.0::DOUBLE / first, 0)), 9) AS mrr
FROM (SELECT unnest(['vector', 'hybrid']) AS mode, * FROM items) LEFT JOIN met USING (mode, query_id) GROUP BY mode"""

_LINES = "SELECT source || '/' || doc_id || '.txt' AS file, string_split(coalesce(text, ''), chr(10)) AS l FROM documents"
CHUNK_FIXED = f"""SELECT file, CAST(s + 1 AS INTEGER) AS start_line, CAST(least(s + 30, len(l)) AS INTEGER) AS end_line, array_to_string(l[s + 1 : s + 30], chr(10)) AS content
FROM (SELECT file, l, unnest(range(0, len(l), 30)) AS s FROM ({_LINES})) WHERE regexp_matches(array_to_string(l[s + 1 : s + 30], ' '), '[^\\s]')"""
LINE_SLICE = f"""SELECT file, CAST(i AS INTEGER) AS line_no, CASE WHEN i < 1000 THEN lpad(CAST(i AS VARCHAR), 4, ' ') ELSE CAST(i AS VARCHAR) END || ' | ' || l[i] AS line
FROM (SELECT file, l, unnest(range(3, least(8, len(l)) + 1)) AS i FROM ({_LINES}))"""
REGEX_SEARCH = f"""SELECT file, CAST(i AS INTEGER) AS line_no, substr(regexp_replace(l[i], '^\\s+|\\s+$', '', 'g'), 1, 120) AS line
FROM (SELECT file, l, unnest(range(1, len(l) + 1)) AS i FROM ({_LINES})) WHERE regexp_matches(l[i], '[Ll]icense') ORDER BY file, line_no LIMIT 50"""
SNIPPETS = "SELECT doc_id, replace(substr(coalesce(text, ''), 1, 150), chr(10), ' ') AS snippet, substr(text, 1, 500) AS clipped FROM documents"

INDEX_EMBEDDED = f"""SELECT file || ':' || start_line || '-' || end_line AS uid, 26 AS size,
{", ".join(f"CAST(length(content) - length(replace(content, '{c}', '')) AS BIGINT) AS {c}" for c in "aez")} FROM ({CHUNK_FIXED})"""
SETTINGS_MERGED = """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) ELSE -1 END AS agent_k, event_type AS kind,
CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS user, CASE WHEN event_id % 3 = 1 THEN CAST(json_extract(props, '$.k') AS BIGINT) ELSE -2 END AS rag_k, true AS rag_on FROM events"""

_SNAPS = """disk AS (SELECT CAST(doc_id AS VARCHAR) AS file, CASE WHEN doc_id % 7 = 0 THEN n_chars + 0.5 ELSE n_chars END::DOUBLE AS mtime FROM documents WHERE doc_id % 5 <> 0),
state AS (SELECT CAST(doc_id AS VARCHAR) AS file, n_chars::DOUBLE AS mtime FROM documents WHERE doc_id % 3 <> 0),
ch AS (SELECT file, CASE WHEN d.mtime IS NULL THEN 'deleted' WHEN s.mtime IS NULL THEN 'new' WHEN d.mtime = s.mtime THEN 'unchanged' ELSE 'changed' END AS change
       FROM disk d FULL JOIN state s USING (file)),
old AS (SELECT CAST(doc_id AS VARCHAR) || ':1-1' AS uid, CAST(doc_id AS VARCHAR) AS file, 'old ' || lang AS document FROM documents WHERE doc_id % 3 <> 0),
fresh AS (SELECT CAST(doc_id AS VARCHAR) || ':1-1' AS uid, CAST(doc_id AS VARCHAR) AS file, 'new ' || lang AS document FROM documents JOIN ch ON file = CAST(doc_id AS VARCHAR) WHERE change IN ('new', 'changed'))"""
INDEX_DIFF = f"WITH {_SNAPS} SELECT file, change FROM ch"
_INDEX = """SELECT * FROM fresh UNION ALL
SELECT * FROM old WHERE file NOT IN (SELECT file FROM ch WHERE change IN ('deleted', 'changed')) AND uid NOT IN (SELECT uid FROM fresh)"""
INDEX_UPSERT = f"WITH {_SNAPS} {_INDEX}"
INDEX_SUMMARY = f"""WITH {_SNAPS}, i AS ({_INDEX})
SELECT count(DISTINCT file) AS files, count(*) AS chunks, (SELECT count(*) FROM ch WHERE change = 'deleted') AS removed FROM i"""

_BUILD = f"""d AS (SELECT *, source || '/' || doc_id || '.txt' AS file FROM documents),
disk AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN n_chars + 0.5 ELSE n_chars END::DOUBLE AS mtime FROM d WHERE doc_id % 5 <> 0),
known AS (SELECT file, lang, n_chars::DOUBLE AS mtime FROM d WHERE doc_id % 3 <> 0),
todo AS (SELECT file FROM disk WHERE file NOT IN (SELECT k.file FROM known k JOIN disk x ON k.file = x.file AND k.mtime = x.mtime)),
gone AS (SELECT file FROM known WHERE file NOT IN (SELECT file FROM disk)),
fresh AS (SELECT file || ':' || start_line || '-' || end_line AS uid, file, start_line, end_line, content AS document FROM ({CHUNK_FIXED}) WHERE file IN (SELECT file FROM todo)),
made AS (SELECT * FROM fresh UNION ALL SELECT file || ':1-1', file, 1, 1, lang FROM known WHERE file NOT IN (SELECT file FROM todo UNION ALL SELECT file FROM gone))"""
INDEX_BUILD = f"WITH {_BUILD} SELECT uid, file, start_line, end_line, document, CAST(length(document) AS INTEGER) AS n_chars FROM made"
INDEX_BUILD_SUMMARY = f"WITH {_BUILD} SELECT *, files + removed = 0 AS up_to_date FROM (SELECT (SELECT count(*) FROM todo) AS files, (SELECT count(*) FROM fresh) AS chunks, (SELECT count(*) FROM gone) AS removed)"

FOLDER_BUILD = """WITH d AS (SELECT *, doc_id % 4 = 1 OR doc_id % 5 = 0 AS late,
    source || '/' || CASE WHEN doc_id % 7 = 0 THEN '__init_' ELSE 'd' END || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.py' ELSE '.txt' END AS file FROM documents),
t AS (SELECT file, string_split(coalesce(text, '') || CASE WHEN late THEN ' second' ELSE ' first' END, chr(10)) AS l FROM d WHERE doc_id % 3 <> 0),
w AS (SELECT file, l, unnest(range(0, len(l), 30)) AS s FROM t),
c AS (
  SELECT file, CAST(s + 1 AS INTEGER) AS start_line, CAST(least(s + 30, len(l)) AS INTEGER) AS end_line, array_to_string(l[s + 1 : s + 30], chr(10)) AS document
  FROM w WHERE regexp_matches(array_to_string(l[s + 1 : s + 30], ' '), '[^\\s]')
  UNION ALL SELECT file, 4, 5, 'def first(a):' || chr(10) || '    return ' || (n_chars + CASE WHEN late THEN 1 ELSE 0 END) FROM d WHERE doc_id % 3 = 0
  UNION ALL SELECT file, 7, 8, 'class Second:' || chr(10) || '    size = 1' FROM d WHERE doc_id % 3 = 0)
SELECT file || ':' || start_line || '-' || end_line AS uid, * FROM c"""

FOLDER_SCAN = """WITH f AS (SELECT *, doc_id % 6 AS s, source || '/.hidden/' || doc_id || CASE doc_id % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.cpp' ELSE '.md' END AS file
  FROM documents WHERE doc_id % 11 > 2 AND doc_id % 6 IN (0, 1, 3))
SELECT kind, file, CAST(octet_length(encode(coalesce(text, ''))) + 3 AS BIGINT) AS size, md5(coalesce(text, '')) AS digest
FROM f, (VALUES ('index'), ('search')) k(kind) WHERE kind = 'index' OR s <> 1"""
FOLDER_ENTRIES = """SELECT '.' || doc_id AS entry FROM documents WHERE doc_id % 3 = 0
UNION SELECT source || '/' FROM documents WHERE doc_id % 3 = 1
UNION SELECT '_' || doc_id || ' [x].bin' FROM documents WHERE doc_id % 3 = 2"""
STATE_KEPT = "SELECT source || '/\"é\" ' || doc_id AS file, n_chars + 0.25::DOUBLE AS mtime FROM documents"
INDEX_READ = """SELECT CAST(doc_id AS VARCHAR) AS uid, CASE WHEN doc_id % 3 <> 0 THEN source ELSE '' END AS file,
  CASE WHEN doc_id % 5 <> 0 THEN coalesce(text, '') ELSE '' END AS document FROM documents"""
EVAL_ITEMS_READ = "SELECT text AS query, 'src' || (item_id % 20) || ',' || item_id AS relevant FROM benchmark"

TOKEN_ESTIMATE = "SELECT conv_id, CAST(trunc(sum(length(coalesce(text, ''))) / 3.0::DOUBLE * 1.2::DOUBLE) AS INTEGER) AS tokens FROM conversations GROUP BY conv_id"
def _trim(chars: str) -> str:
    return f"""WITH m AS (SELECT conv_id, turn::DOUBLE AS turn, role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 AND role = 'system' AS head,
    CAST(trunc(({chars}) / 3.0::DOUBLE * 1.2::DOUBLE) AS INTEGER) AS tok FROM conversations),
s AS (SELECT *, sum(CASE WHEN head THEN 0 ELSE tok END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    + sum(CASE WHEN head THEN tok ELSE 0 END) OVER (PARTITION BY conv_id) <= 400 AS fits FROM m),
k AS (SELECT *, NOT head AND fits AND turn >= min(CASE WHEN NOT head AND fits AND role <> 'tool' THEN turn END) OVER (PARTITION BY conv_id) AS stay0 FROM s),
t AS (SELECT *, coalesce(stay0, false) AS stay FROM k)
SELECT conv_id, turn, role, text FROM t WHERE head OR stay
UNION ALL SELECT conv_id, coalesce(min(CASE WHEN stay THEN turn END), max(turn) + 1) - 0.5, 'system', '[earlier messages were cut]' FROM t WHERE NOT head GROUP BY conv_id HAVING count(*) FILTER (NOT stay) > 0"""


_SAID = "length(coalesce(text, ''))"
_CALLS = _SAID + """ + CASE WHEN role = 'assistant' THEN length('[{"name": "look", "args": {"turn": ' || turn || '}}]') ELSE 0 END"""
CONTEXT_TRIM = _trim(_SAID)
TOOL_CALL_TRIM = _trim(_CALLS)
TOOL_CALL_ESTIMATE = f"SELECT conv_id, CAST(trunc(sum({_CALLS}) / 3.0::DOUBLE * 1.2::DOUBLE) AS INTEGER) AS tokens FROM conversations GROUP BY conv_id"
HISTORY = """WITH u AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, text FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, text FROM conversations WHERE role = 'assistant')
SELECT conv_id, CAST(2 * i AS INTEGER) AS pos, 'user' AS role, text FROM u WHERE text <> ''
UNION ALL SELECT conv_id, CAST(2 * i + 1 AS INTEGER), 'assistant', a.text FROM a JOIN u USING (conv_id, i) WHERE a.text <> ''"""
HISTORY_APPEND = f"""{HISTORY}
UNION ALL SELECT c.conv_id, CAST(2 * (n + i - 1) + j AS INTEGER), CASE j WHEN 0 THEN 'user' ELSE 'assistant' END, CASE j WHEN 0 THEN 'q' || i || ' ' || c.conv_id ELSE 'a' || i END
FROM (SELECT conv_id FROM conversations WHERE turn = 0 AND role = 'user') c
JOIN (SELECT conv_id, count(*) FILTER (role = 'user') AS n FROM conversations GROUP BY conv_id) USING (conv_id),
(SELECT unnest([1, 2]) AS i), (SELECT unnest([0, 1]) AS j)
UNION ALL SELECT -1, 0, 'user', 'hello'"""
LAST_QUESTIONS = """SELECT conv_id, turn, text, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS pos FROM
(SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role = 'user') WHERE back <= 2"""

_EV = "ev AS (SELECT user_id AS task_id, event_id AS seq, ts, event_type AS type FROM events)"
_LIFE = "life AS (SELECT user_id AS task_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'created' WHEN 'view' THEN 'started' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'tool_call' END AS type FROM events)"
EVENTS_RING = f"WITH {_EV} SELECT task_id, seq, type FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY seq DESC) AS b FROM ev) WHERE b <= 50"
EVENTS_SINCE = f"WITH {_EV} SELECT task_id, seq, type FROM ev WHERE seq > 100 * (task_id % 50)"
EVENTS_CURSORS = f"WITH {_EV} SELECT task_id, greatest(100 * (task_id % 50), max(seq)) AS cursor FROM ev GROUP BY task_id"
EVENTS_FEED = f"WITH {_EV} SELECT task_id, seq, type FROM ev ORDER BY ts DESC, seq DESC LIMIT 60"
EVENTS_CLEAR = f"WITH {_EV} SELECT task_id, seq, type FROM ev WHERE task_id % 3 <> 0"
EVENT_TYPES = f"""WITH {_LIFE}, {_EV} SELECT type, type IN ('created', 'started', 'completed', 'failed', 'tool_call') AS known, count(*) AS events
FROM (SELECT type FROM life UNION ALL SELECT type FROM ev) GROUP BY type"""
_STATUS = f"""{_LIFE},
f AS (SELECT task_id, min(seq) FILTER (type = 'started') AS st, min(seq) FILTER (type = 'completed') AS co, min(seq) FILTER (type = 'failed') AS fa FROM life WHERE type <> 'tool_call' GROUP BY task_id),
status AS (SELECT task_id, CASE WHEN co IS NOT NULL AND (fa IS NULL OR co < fa) THEN 'completed' WHEN fa IS NOT NULL THEN 'failed' WHEN st IS NOT NULL THEN 'running' ELSE 'pending' END AS status FROM f)"""
STATUS_FOLD = f"WITH {_STATUS} SELECT task_id, status FROM status"
_METRICS = "SELECT count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed FROM status"
TASK_METRICS = f"WITH {_STATUS} {_METRICS}"
_PAGE = " || ".join(
    f"'# HELP tasks_{k} {v}' || chr(10) || '# TYPE tasks_{k} counter' || chr(10) || 'tasks_{k} ' || {k} || chr(10)"
    for k, v in (("total", "Total tasks submitted"), ("completed", "Total tasks completed"), ("failed", "Total tasks failed"))
)
METRICS_PAGE = f"WITH {_STATUS}, m AS ({_METRICS}) SELECT {_PAGE} AS page FROM m"
RECENT_TASKS = f"WITH {_STATUS} SELECT task_id, status FROM status ORDER BY task_id DESC LIMIT 8"
TASK_GAUGES = f"""WITH {_STATUS} SELECT n AS running, u AS used, least(u, 100) AS width FROM (SELECT n, CAST(floor(n / 5.0::DOUBLE * 100 + 0.5) AS BIGINT) AS u
FROM (SELECT count(*) FILTER (status IN ('running', 'failed')) AS n FROM status))"""

RPC_KIND = """SELECT event_id, CASE event_type WHEN 'click' THEN 'response' WHEN 'error' THEN 'error' WHEN 'view' THEN 'request' ELSE 'notification' END AS kind FROM events"""
DENYLIST = """SELECT doc_id, list_bool_or(list_transform(['rm-rf','rm-fr','rm-r-f','rm-f-r','mkfs','format','ddif=',':(){','chmod777/','rd/s','rmdir/s','del/f','remove-item','shutdown','reboot'],
lambda p: contains(replace(lower('run ' || coalesce(text, '') || CASE WHEN doc_id % 9 = 0 THEN ' RM  -R -f /' WHEN doc_id % 9 = 1 THEN ' git log --Format=x' ELSE '' END), ' ', ''), p))) AS denied FROM documents"""
URL_SCHEME = "SELECT page_id, regexp_matches(url, '^https?://') AS is_web FROM pages"
TOOL_NAMES = "SELECT event_id, 'mcp_' || event_type || '_' || user_id AS name FROM events"
EVAL_VALID = "SELECT item_id FROM benchmark WHERE trim(text) <> '' AND item_id % 4 <> 0"
MODEL_FIRST = "SELECT coalesce(min_by(c_name, c_custkey), 'none') AS name FROM customer WHERE trim(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 1 THEN 'sk-xxx' ELSE ' ' END) <> '' AND c_custkey % 3 <> 1"
TOOL_ARGS = "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'kind,user' ELSE 'kind' END AS kept FROM events"
CONTENT_TEXT = "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'user') AS text FROM conversations GROUP BY conv_id"
TOOL_HEALTH = "SELECT 'ok' AS status, '1' AS version, count(DISTINCT event_type) AS tools_count FROM events"
