"""Named queries of the library over the fixture tables, and the SQL that states their results.

The fixtures stand in for the library's own inputs: ``documents`` for files and chunks
(``source`` as the file), ``embeddings`` for their vectors (``vec_id`` taken as the uid),
``benchmark`` for queries, ``events`` for task events (``user_id`` as the task, ``event_id`` as
the sequence) and ``conversations`` for message lists.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.functions import ranking, text
from tamarack.operators import chunks, dialogue, embedding, events, index, neighbours, postings, protocol, retrieval, settings
from tamarack.plans import sql
from tamarack.sources import files, pages, shared, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _chunks(spark, d):
    return retrieval.documents_as_chunks(table(spark, d, "documents"))


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("uid"), "embedding")


def _asked(spark, d):
    """Benchmark items as queries; an item's vector is the one of that number."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return items.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding"), "query_id", "left")


def _files(spark, d):
    name = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, d, "documents").select(name.alias("file"), F.col("text").alias("content"))


# --- retrieval ---


@query
def token_stats(spark, d):
    return retrieval.token_stats(_chunks(spark, d))


@query
def document_frequency(spark, d):
    return retrieval.document_frequency(_chunks(spark, d))


@query
def corpus_stats(spark, d):
    return retrieval.corpus_stats(_chunks(spark, d))


@query
def bm25_topk(spark, d):
    return retrieval.retrieve(_chunks(spark, d), _vectors(spark, d), _asked(spark, d), 10, "bm25").select("query_id", "uid", "score", "bm25_rank")


@query
def vector_topk(spark, d):
    asked = table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.vector_topk(_vectors(spark, d), asked)


@query
def vector_cells(spark, d):
    """Approximate: every vector is indexed in its cell; queries look at the cells that the fit chose."""
    vectors = _vectors(spark, d)
    cells = neighbours.fit(vectors)
    asked = table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return neighbours.search(neighbours.indexed(vectors, cells), asked, cells)


@query
def vector_blocks(spark, d):
    """Exact, for any number of queries: every vector asks for its own neighbours, joined in blocks."""
    vectors = _vectors(spark, d)
    hits = neighbours.exact(vectors, vectors.select(F.col("uid").cast("long").alias("query_id"), "embedding"), 3)
    return ranking.ranked(hits, 3, "vector_rank")


@query
def rrf_hybrid(spark, d):
    return retrieval.retrieve(_chunks(spark, d), _vectors(spark, d), _asked(spark, d))


@query
def hit_lines(spark, d):
    return retrieval.formatted(rrf_hybrid(spark, d), _chunks(spark, d))


@query
def search_report(spark, d):
    """The fixture's places in a file: an id's remainder by 90."""
    placed = _chunks(spark, d).withColumn("start_line", (F.col("uid").cast("long") % 90).cast("int"))
    asked = _asked(spark, d).withColumn("query", F.when(F.col("query_id") % 10 == 0, "zzzzqqqq qqqqzzzz").otherwise(F.col("query")))
    hits = retrieval.retrieve(_chunks(spark, d), _vectors(spark, d), asked, 10, "bm25").withColumn("rank", F.col("bm25_rank"))
    return retrieval.report(retrieval.formatted(hits, placed, hybrid=False), asked)


@query
def retrieval_eval(spark, d):
    items = _asked(spark, d)
    relevant = F.array(F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")), F.col("query_id").cast("string"))
    modes = retrieval.compared(_chunks(spark, d), _vectors(spark, d), items)
    return retrieval.evaluate(modes, _chunks(spark, d), items.select("query_id", "query", relevant.alias("relevant")))


# --- files and chunks ---


@query
def chunk_fixed(spark, d):
    return chunks.fixed(_files(spark, d))


@query
def line_slice(spark, d):
    return chunks.line_slice(_files(spark, d), 2, 8).where("line_no > 2")


@query
def regex_search(spark, d):
    return chunks.regex_search(_files(spark, d), "[Ll]icense")


@query
def snippets(spark, d):
    return table(spark, d, "documents").select("doc_id", text.snippet(F.col("text")).alias("snippet"), text.clip(F.col("text"), 500).alias("clipped"))


@query
def chunk_python(spark, d):
    """Every document's whole text: in a small module's docstring, behind a syntax error, or bare."""
    module = "x = 1\n\n@wraps\ndef first(a):\n    return a\n\nclass Second:\n    def inner(self):\n        pass\n"
    said = F.translate("text", "\\\"", "  ")
    body = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(module + '\ndef third():\n    """'), said, F.lit('"""\n')))
    body = body.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("def broken(:\n"), "text")).otherwise(F.col("text"))
    name = F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 4 == 0, ".md").otherwise(".py"))
    return chunks.chunk(table(spark, d, "documents").select(name.alias("file"), body.alias("content")))


@query
def page_text(spark, d):
    return pages.page_text(table(spark, d, "pages"))


# --- index ---


def _snapshots(spark, d):
    docs = table(spark, d, "documents")
    file, chars = F.col("doc_id").cast("string").alias("file"), F.col("n_chars").cast("double")
    disk = docs.where("doc_id % 5 <> 0").select(file, F.when(F.col("doc_id") % 7 == 0, chars + 0.5).otherwise(chars).alias("mtime"))
    state = docs.where("doc_id % 3 <> 0").select(file, chars.alias("mtime"))
    rows = lambda df, word: df.select(
        F.concat(F.col("doc_id").cast("string"), F.lit(":1-1")).alias("uid"), file, F.concat(F.lit(word + " "), F.col("lang")).alias("document")
    )
    return index.diff(disk, state), rows(docs.where("doc_id % 3 <> 0"), "old"), rows(docs, "new")


@query
def index_diff(spark, d):
    return _snapshots(spark, d)[0]


@query
def index_upsert(spark, d):
    changes, old, new = _snapshots(spark, d)
    fresh = new.join(changes.where("change in ('new', 'changed')").select("file"), "file").select(*old.columns)
    return index.refresh(old, changes, fresh)


@query
def index_summary(spark, d):
    return index.summary(index_upsert(spark, d), _snapshots(spark, d)[0])


def _built(spark, d):
    """Documents as files; the state knows two thirds of them, a seventh at another time."""
    docs = table(spark, d, "documents").withColumn("file", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    chars = F.col("n_chars").cast("double")
    disk = docs.where("doc_id % 5 <> 0").select("file", F.when(F.col("doc_id") % 7 == 0, chars + 0.5).otherwise(chars).alias("mtime"), F.col("text").alias("content"))
    known = docs.where("doc_id % 3 <> 0")
    old = known.select(F.concat("file", F.lit(":1-1")).alias("uid"), "file", F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.col("lang").alias("document"))
    size = lambda chunks: chunks.withColumn("n_chars", F.length("document"))
    return index.build(disk, known.select("file", chars.alias("mtime")), size(old), size)


@query
def index_build(spark, d):
    return _built(spark, d).index


@query
def index_build_summary(spark, d):
    return _built(spark, d).summary


@query
def index_store(spark, d):
    """The upsert of ``index_upsert`` in a kept table, of which touched parts are written again."""
    changes, old, new = _snapshots(spark, d)
    kept = store.Store(spark, shared.fresh_path(spark, "store"), parts=32)
    kept.update(old.select("file").limit(0), old)
    fresh = new.join(changes.where("change in ('new', 'changed')").select("file"), "file").select(*old.columns)
    kept.update(changes.where("change in ('deleted', 'changed')"), fresh)
    return kept.read()


@query
def bm25_indexed(spark, d):
    """A kept inverted index after three builds: a third of the chunks, stale ones among them, the
    others, and the stale ones anew."""
    built = postings.Postings(spark, shared.fresh_path(spark, "postings"), folders=8)
    docs, number = _chunks(spark, d), F.col("uid").cast("long")
    stale = docs.where(number % 6 == 0).withColumn("document", F.concat(F.lit("stale "), F.coalesce("document", F.lit(""))))
    built.add(docs.where(number % 6 == 3).unionByName(stale))
    built.add(docs.where(number % 3 != 0))
    built.add(docs.where(number % 6 == 0), stale)
    asked = _asked(spark, d).where(F.trim(F.coalesce("query", F.lit(""))) != "")
    return built.search(asked.select("query_id", "query")).select("query_id", "uid", "score", "bm25_rank")


@query
def index_embedded(spark, d):
    """Fresh chunks with vectors of a model that is loaded once a worker: here counts of letters."""
    built = index.build(_files(spark, d).withColumn("mtime", F.lit(1.0)), spark.createDataFrame([], "file string, mtime double"), None, lambda fresh: embedding.embedded(fresh, embedding.letters))
    at = lambda i: F.get("embedding", F.lit(i)).cast("long")
    return built.index.select("uid", F.size("embedding").alias("size"), at(0).alias("a"), at(4).alias("e"), at(25).alias("z"))


def _on_disk(spark, d, word: str, more: int):
    """Documents as files: a third of them modules of Python, the others their texts and ``word``."""
    number = F.col("doc_id").cast("string")
    module = F.concat(F.lit("x = "), number, F.lit("\n\n@wraps\ndef first(a):\n    return "), (F.col("n_chars") + more).cast("string"), F.lit("\n\nclass Second:\n    size = 1\n"))
    is_module = F.col("doc_id") % 3 == 0
    name = F.concat("source", F.lit("/"), F.when(F.col("doc_id") % 7 == 0, "__init_").otherwise("d"), number, F.when(is_module, ".py").otherwise(".txt"))
    said = F.when(is_module, module).otherwise(F.concat(F.coalesce("text", F.lit("")), F.lit(word)))
    return table(spark, d, "documents").select("doc_id", name.alias("file"), said.alias("content"))


@query
def folder_build(spark, d):
    """Files are written, indexed, partly changed and added to, and indexed again: of the second
    build only these are opened. Skipped folders and other suffixes hold a copy of each."""
    root, kept = shared.fresh_path(spark, "files"), shared.fresh_path(spark, "built")
    one, two = _on_disk(spark, d, " first", 0), _on_disk(spark, d, " second", 1)
    odd = one.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("node_modules/"), "file")).otherwise(F.concat("file", F.lit(".bin"))).alias("file"), "content")
    files.write_files(one.where("doc_id % 4 <> 1").unionByName(odd), root)
    first = index.build_folder(spark, root, spark.createDataFrame([], "file string, mtime double"))
    first.index.write.parquet(f"{kept}/index")
    files.write_state(first.state, f"{kept}/state")
    files.write_files(two.where("doc_id % 4 = 1 or doc_id % 5 = 0"), root)
    return index.build_folder(spark, root, files.read_state(spark, f"{kept}/state"), spark.read.parquet(f"{kept}/index")).index


@query
def folder_scan(spark, d):
    """Every document as a file, with bytes that aren't UTF-8 around its text; the scan of an
    index and that of a search each read the files of their own suffixes outside skipped folders."""
    number = F.col("doc_id").cast("string")
    suffix = F.element_at(F.array(*map(F.lit, (".py", ".cpp", ".PY", ".md", ".bin", ""))), (F.col("doc_id") % 6 + 1).cast("int"))
    folder = F.when(F.col("doc_id") % 11 == 0, "/sub/.git/").when(F.col("doc_id") % 11 == 1, "/node_modules/deep/").when(F.col("doc_id") % 11 == 2, "/.tamarack/").otherwise("/.hidden/")
    said = F.concat(F.unhex(F.lit("FFFE")), F.encode(F.coalesce("text", F.lit("")), "UTF-8"), F.unhex(F.lit("C3")))
    root = shared.fresh_path(spark, "scanned")
    files.write_files(table(spark, d, "documents").select(F.concat("source", folder, number, suffix).alias("file"), said.alias("content")), root)
    read = lambda kind, suffixes: files.scan(spark, root, suffixes).select(F.lit(kind).alias("kind"), "file", "size", F.md5("content").alias("digest"))
    return read("index", files.INDEXED).unionByName(read("search", files.SEARCHED))


@query
def folder_entries(spark, d):
    """What stands right under a folder: files of any name, and folders with a slash."""
    number = F.col("doc_id").cast("string")
    name = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("."), number)).when(F.col("doc_id") % 3 == 1, F.concat("source", F.lit("/inner/"), number)).otherwise(F.concat(F.lit("_"), number, F.lit(" [x].bin")))
    root = shared.fresh_path(spark, "entries")
    files.write_files(table(spark, d, "documents").select(name.alias("file"), F.col("lang").alias("content")), root)
    return files.listing(spark, root)


@query
def state_kept(spark, d):
    """An index's state, written and read again beside a part that is no JSON."""
    path = shared.fresh_path(spark, "state")
    files.write_state(table(spark, d, "documents").select(F.concat("source", F.lit('/"é" '), F.col("doc_id").cast("string")).alias("file"), (F.col("n_chars") + 0.25).alias("mtime")), path)
    spark.range(1).select(F.lit('{"broken": 1').alias("value")).write.mode("append").text(path)
    return files.read_state(spark, path)


@query
def index_read(spark, d):
    """A kept index with other columns; missing files and texts are empty."""
    path = shared.fresh_path(spark, "index")
    missing = lambda c, n: F.when(F.col("doc_id") % n != 0, F.col(c))
    table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("uid"), missing("source", 3).alias("file"), missing("text", 5).alias("document"), "n_chars").write.parquet(path)
    return files.read_index(spark, path)


@query
def eval_items_read(spark, d):
    """Evaluation items as JSON lists, a file for each of eight groups of them."""
    item = F.struct(F.col("text").alias("query"), F.array(F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")), F.col("item_id").cast("string")).alias("relevant"))
    path = shared.fresh_path(spark, "items")
    lists = table(spark, d, "benchmark").groupBy((F.col("item_id") % 8).alias("g")).agg(F.to_json(F.collect_list(item)).alias("value"))
    lists.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return files.read_eval(spark, path).select("query", F.array_join("relevant", ",").alias("relevant"))


# --- conversations ---


@query
def token_estimate(spark, d):
    return dialogue.estimate(table(spark, d, "conversations"))


def _calls(spark, d):
    call = F.concat(F.lit('[{"name": "look", "args": {"turn": '), F.col("turn").cast("string"), F.lit("}}]"))
    return table(spark, d, "conversations").withColumn("tool_calls", F.when(F.col("role") == "assistant", call))


@query
def tool_call_estimate(spark, d):
    return dialogue.estimate(_calls(spark, d))


@query
def tool_call_trim(spark, d):
    return dialogue.trim(_calls(spark, d), 400)


@query
def context_trim(spark, d):
    return dialogue.trim(table(spark, d, "conversations"), 400)


def _pairs(spark, d):
    """The n-th user and the n-th assistant message of a conversation make its n-th turn."""
    c = table(spark, d, "conversations")
    said = lambda role: F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"])
    per = c.groupBy("conv_id").agg(said("user").alias("u"), said("assistant").alias("a"))
    zipped = F.zip_with("u", "a", lambda u, a: F.struct(u.alias("user"), a.alias("assistant")))
    pairs = per.select("conv_id", F.slice(zipped, F.lit(1), F.greatest(F.size("u"), F.lit(0))).alias("turns"))
    return pairs


@query
def history_messages(spark, d):
    return dialogue.history(_pairs(spark, d))


@query
def history_append(spark, d):
    """Two turns more for every conversation that starts with a user, one for a new one."""
    first = table(spark, d, "conversations").where("turn = 0 and role = 'user'")
    said = F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.concat(F.lit(f"q{i} "), F.col("conv_id").cast("string")).alias("user"), F.lit(f"a{i}").alias("assistant")) for i in (2, 1)]))
    more = first.select("conv_id", said.alias("s")).select("conv_id", "s.*")
    new = spark.createDataFrame([(-1, 1, "hello", "")], more.schema)
    return dialogue.history(dialogue.append(_pairs(spark, d), more.unionByName(new)))


@query
def last_questions(spark, d):
    return dialogue.last_questions(table(spark, d, "conversations"), 2)


# --- events ---


def _events(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("type"))


def _lifecycle(spark, d):
    """The fixture's types read as lifecycle types."""
    of = F.create_map(*[F.lit(x) for x in ("signup", "created", "view", "started", "purchase", "completed", "error", "failed", "click", "tool_call")])
    return _events(spark, d).withColumn("type", F.element_at(of, F.col("type")))


def _cursors(spark, d):
    return _events(spark, d).select("task_id").distinct().withColumn("cursor", (F.col("task_id") % 50) * 100)


_OUT = ("task_id", "seq", "type")


@query
def events_ring(spark, d):
    return events.ring(_events(spark, d), 50).select(*_OUT)


@query
def events_since(spark, d):
    return events.since(_events(spark, d), _cursors(spark, d)).select(*_OUT)


@query
def events_cursors(spark, d):
    return events.next_cursors(_events(spark, d), _cursors(spark, d))


@query
def events_feed(spark, d):
    return events.feed(_events(spark, d)).select(*_OUT)


@query
def events_clear(spark, d):
    gone = _events(spark, d).where("task_id % 3 = 0").select("task_id").distinct()
    return events.clear(_events(spark, d), gone).select(*_OUT)


@query
def events_evict(spark, d):
    got = events.evict(_events(spark, d).withColumn("arrival", F.col("seq")).select("arrival", *_OUT), 50, 2000)
    return got.select(*_OUT)


@query
def event_types(spark, d):
    return events.by_type(_lifecycle(spark, d).unionByName(_events(spark, d)))


@query
def status_fold(spark, d):
    return events.statuses(_lifecycle(spark, d))


@query
def task_metrics(spark, d):
    return events.metrics(status_fold(spark, d))


@query
def metrics_page(spark, d):
    return events.exposition(task_metrics(spark, d))


@query
def recent_tasks(spark, d):
    return events.recent(status_fold(spark, d).withColumn("submit_seq", F.col("task_id"))).select("task_id", "status")


@query
def task_gauges(spark, d):
    busy = status_fold(spark, d).withColumn("status", F.when(F.col("status") == "failed", "running").otherwise(F.col("status")))
    return events.gauges(busy)


# --- messages and catalogs ---


@query
def rpc_kind(spark, d):
    body = (
        F.when(F.col("event_type") == "click", F.lit('{"id": 1, "result": null}'))
        .when(F.col("event_type") == "error", F.lit('{"id": 1, "error": {"code": 1}}'))
        .when(F.col("event_type") == "view", F.lit('{"id": "a", "method": "m"}'))
        .otherwise(F.lit('{"id": null, "method": "m"}'))
    )
    return table(spark, d, "events").select("event_id", protocol.rpc_kind(body).alias("kind"))


@query
def denylist_flag(spark, d):
    tail = F.when(F.col("doc_id") % 9 == 0, " RM  -R -f /").when(F.col("doc_id") % 9 == 1, " git log --Format=x").otherwise("")
    return table(spark, d, "documents").select("doc_id", protocol.denied(F.concat(F.lit("run "), F.coalesce("text", F.lit("")), tail)).alias("denied"))


@query
def url_scheme(spark, d):
    return table(spark, d, "pages").select("page_id", protocol.is_web(F.col("url")).alias("is_web"))


@query
def tool_names(spark, d):
    return table(spark, d, "events").select("event_id", protocol.tool_name(F.col("event_type"), F.col("user_id").cast("string")).alias("name"))


@query
def tool_arguments(spark, d):
    user = F.when(F.col("event_id") % 2 == 0, F.col("user_id").cast("string"))
    given = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("user"), user, F.lit("workdir"), F.lit("/tmp"))
    return table(spark, d, "events").select("event_id", F.array_join(F.map_keys(protocol.clean_arguments(given)), ",").alias("kept"))


@query
def content_text(spark, d):
    kind = F.when(F.col("role") == "user", "text").otherwise("image")
    per = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", kind.alias("type"), "text"))).alias("c"))
    said = protocol.content_text(F.transform("c", lambda x: F.struct(x["type"].alias("type"), x["text"].alias("text"))))
    return per.select("conv_id", F.when(F.exists("c", lambda x: x["type"] == "text"), said).alias("text"))


@query
def eval_items_valid(spark, d):
    items = table(spark, d, "benchmark").withColumn("relevant", F.array(F.when(F.col("item_id") % 4 == 0, " ").otherwise("src1")))
    return retrieval.valid_items(items.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), "relevant")).select(F.col("query_id").alias("item_id"))


@query
def settings_merged(spark, d):
    """Defaults from an event's columns, overridden by its ``props`` under two keys, and by null."""
    base = F.to_json(F.struct(F.struct(F.lit(-1).alias("k"), F.col("event_type").alias("kind")).alias("agent"), F.col("user_id").alias("user"), F.struct(F.lit(True).alias("on")).alias("rag")))
    props = F.coalesce("props", F.lit("{}"))
    override = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"agent": '), props, F.lit(', "user": null}'))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"rag": '), props, F.lit("}")))
    rows = table(spark, d, "events").select("event_id", settings.merged(base, override).alias("c"))
    at = lambda path, kind, default=None: settings.lookup(F.col("c"), path, kind, default)
    return rows.select("event_id", at("agent.k", "long").alias("agent_k"), at("agent.kind", "string").alias("kind"), at("user", "long", 0).alias("user"), at("rag.k", "long", -2).alias("rag_k"), at("rag.on", "boolean").alias("rag_on"))


@query
def tool_health(spark, d):
    return protocol.health(table(spark, d, "events").select(F.col("event_type").alias("name")).distinct())


@query
def model_first(spark, d):
    key = F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).when(F.col("c_custkey") % 3 == 1, "sk-xxx").otherwise(" ")
    return protocol.first_available(table(spark, d, "customer").select(F.col("c_custkey").alias("ordinal"), F.col("c_name").alias("name"), key.alias("key")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {
        "token_stats": sql.TOKEN_STATS,
        "document_frequency": sql.DOCUMENT_FREQUENCY,
        "corpus_stats": sql.CORPUS_STATS,
        "bm25_topk": sql.BM25_TOPK,
        "vector_topk": sql.VECTOR_TOPK,
        "vector_blocks": sql.VECTOR_BLOCKS,
        "rrf_hybrid": sql.RRF_HYBRID,
        "hit_lines": sql.HIT_LINES,
        "retrieval_eval": sql.RETRIEVAL_EVAL,
        "search_report": sql.SEARCH_REPORT,
        "index_build": sql.INDEX_BUILD,
        "index_build_summary": sql.INDEX_BUILD_SUMMARY,
        "tool_call_estimate": sql.TOOL_CALL_ESTIMATE,
        "tool_call_trim": sql.TOOL_CALL_TRIM,
        "history_append": sql.HISTORY_APPEND,
        "tool_health": sql.TOOL_HEALTH,
        "chunk_fixed": sql.CHUNK_FIXED,
        "line_slice": sql.LINE_SLICE,
        "regex_search": sql.REGEX_SEARCH,
        "snippets": sql.SNIPPETS,
        "index_diff": sql.INDEX_DIFF,
        "index_upsert": sql.INDEX_UPSERT,
        "index_summary": sql.INDEX_SUMMARY,
        "index_store": sql.INDEX_UPSERT,
        "bm25_indexed": sql.BM25_TOPK,
        "folder_build": sql.FOLDER_BUILD,
        "folder_scan": sql.FOLDER_SCAN,
        "folder_entries": sql.FOLDER_ENTRIES,
        "state_kept": sql.STATE_KEPT,
        "index_read": sql.INDEX_READ,
        "eval_items_read": sql.EVAL_ITEMS_READ,
        "index_embedded": sql.INDEX_EMBEDDED,
        "settings_merged": sql.SETTINGS_MERGED,
        "token_estimate": sql.TOKEN_ESTIMATE,
        "context_trim": sql.CONTEXT_TRIM,
        "history_messages": sql.HISTORY,
        "last_questions": sql.LAST_QUESTIONS,
        "events_ring": sql.EVENTS_RING,
        "events_since": sql.EVENTS_SINCE,
        "events_cursors": sql.EVENTS_CURSORS,
        "events_feed": sql.EVENTS_FEED,
        "events_clear": sql.EVENTS_CLEAR,
        "event_types": sql.EVENT_TYPES,
        "status_fold": sql.STATUS_FOLD,
        "task_metrics": sql.TASK_METRICS,
        "metrics_page": sql.METRICS_PAGE,
        "recent_tasks": sql.RECENT_TASKS,
        "task_gauges": sql.TASK_GAUGES,
        "rpc_kind": sql.RPC_KIND,
        "denylist_flag": sql.DENYLIST,
        "url_scheme": sql.URL_SCHEME,
        "tool_names": sql.TOOL_NAMES,
        "tool_arguments": sql.TOOL_ARGS,
        "content_text": sql.CONTENT_TEXT,
        "eval_items_valid": sql.EVAL_VALID,
        "model_first": sql.MODEL_FIRST,
    }
