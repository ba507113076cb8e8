"""Ranked retrieval over many queries at once: BM25, exact vectors, rank fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.functions.ranking import ranked
from tamarack.functions.text import snippet, tokenize
from tamarack.operators.neighbours import HIT, SLACK, Cells, exact, indexed, search, usable

K1, B = 1.5, 0.75
RRF_K = 60
#: So many query vectors are broadcast at most.
QUERY_BLOCK = 4096
BROADCAST_ROWS = 200_000
#: Scores that a task of BM25 holds at most, if every query meets every chunk.
SCORES = 1 << 20
MOST_TASKS = 20_000
#: Rows multiplied with the queries at once.
TILE = 256
#: Stands for a chunk itself among its tokens, which are never empty.
COUNTED = ""


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Hint a broadcast only if the counted size is within the bound."""
    n = df.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def documents_as_chunks(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("string").alias("uid"), F.col("source").alias("file"), F.col("text").alias("document"))


def tokens_of(chunks: DataFrame) -> DataFrame:
    """``uid, tokens``: the path takes part in the tokens."""
    return chunks.select("uid", tokenize(F.concat_ws(" ", F.coalesce("file", F.lit("")), F.col("document"))).alias("tokens"))


def token_stats(chunks: DataFrame) -> DataFrame:
    t = tokens_of(chunks)
    return t.select("uid", F.size("tokens").cast("long").alias("n_tokens"), F.size(F.array_distinct("tokens")).cast("long").alias("n_distinct"))


def document_frequency(chunks: DataFrame) -> DataFrame:
    return tokens_of(chunks).select(F.explode(F.array_distinct("tokens")).alias("tok")).groupBy("tok").agg(F.count("*").alias("df"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    return tokens_of(chunks).agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))


def bm25_scores(chunks: DataFrame, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """``query_id, uid, score`` of every chunk that shares a token with the query.

    Texts are cut into tokens once. Only occurrences of query terms are shuffled, by uid, and
    with each chunk one ``COUNTED`` row that stands for the chunk itself; frequencies, number
    and lengths of chunks all come from that one exchange, and a chunk's scores are summed
    where it lies. There are so many tasks that each holds ``SCORES`` scores at most, whatever
    the session's own number. Frequencies span the whole corpus.
    """
    asked = queries.select("query_id", F.explode(tokenize(F.col("query"))).alias("tok")).groupBy("query_id", "tok").agg(F.count("*").alias("qtf"))
    n_asked = asked.limit(BROADCAST_ROWS + 1).count()
    own = chunks.sparkSession.createDataFrame([(COUNTED,)], "tok string")
    terms = asked.select("tok").distinct().union(own)
    tokens = tokens_of(chunks).select("uid", "tokens", F.size("tokens").alias("dl"))
    marked = tokens.select("uid", "dl", F.explode(F.array_append("tokens", F.lit(COUNTED))).alias("tok"))
    found = marked.join(small(terms, n_asked), "tok", "left_semi").repartition(_tasks(chunks, queries), "uid")
    tf = found.groupBy("uid", "dl", "tok").agg(F.count("*").alias("tf"))
    per = tf.groupBy("tok").agg(F.count_if(F.col("tf") > 0).alias("df"), F.sum("tf").alias("rows"), F.sum(F.col("dl") * F.col("tf")).alias("length"))
    # not a filter, which would be pushed into the exchange and make it another one
    whole = lambda c: F.max(F.when(F.col("tok") == COUNTED, F.col(c)))
    stats = per.agg(whole("rows").alias("n"), (whole("length") / whole("rows")).alias("avgdl")).where("avgdl > 0")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = asked.join(per, "tok").crossJoin(F.broadcast(stats)).select("query_id", "tok", "avgdl", (F.col("qtf") * idf).alias("w"))
    part = F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = tf.join(small(weights, n_asked), "tok").groupBy("query_id", "uid").agg(F.sum(part).alias("score"))
    return scored.where("score > 0").select("query_id", "uid", F.round("score", 6).alias("score"))


def _tasks(chunks: DataFrame, queries: DataFrame) -> int:
    """For so many scores as there may be, and no fewer than the session's."""
    asked = queries.select("query_id").distinct().count()
    return max(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-chunks.count() * asked // SCORES), MOST_TASKS))


def bm25_topk(chunks: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    return ranked(bm25_scores(chunks, queries), limit, "bm25_rank")


def vector_topk(vectors: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """``query_id, uid, score, vector_rank`` by squared Euclidean distance (score is its negative).

    ``vectors`` has ``uid, embedding``, ``queries`` ``query_id, embedding``. Up to ``QUERY_BLOCK``
    queries are broadcast; each task multiplies tiles of rows with them and keeps ``limit`` a
    query. More of them are joined with the vectors block by block, and none comes to the driver.
    Vectors of another length than a query's are none of its hits; null ones, and those with a
    null element, of no one's. A null query_id is a query as well.
    """
    queries = queries.where(usable(F.col("embedding"))).select("query_id", "embedding")
    rows = vectors.where(usable(F.col("embedding"))).select("uid", "embedding")
    asked = queries.limit(QUERY_BLOCK + 1).collect()
    if len(asked) > QUERY_BLOCK:
        return ranked(exact(rows, queries, limit), limit, "vector_rank")
    by_size: dict[int, tuple[list, list]] = {}
    for r in asked:
        ids, points = by_size.setdefault(len(r["embedding"]), ([], []))
        ids.append(r["query_id"])
        points.append(r["embedding"])
    held = vectors.sparkSession.sparkContext.broadcast({size: (i, np.array(p, np.float64).reshape(len(i), -1)) for size, (i, p) in by_size.items()})
    return ranked(rows.mapInArrow(_nearest(held, limit), HIT), limit, "vector_rank")


def _nearest(held, limit: int):
    """Each task's best ``limit`` rows a query, by rounded score and then uid."""

    def best(parts: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(parts).sort_values(["q", "score", "uid"], ascending=[True, False, True]).groupby("q").head(limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, pd.DataFrame] = {}
        worst = {size: np.full(len(ids), np.inf) for size, (ids, _) in held.value.items()}
        for batch in batches:
            uid, at = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            sizes, flat = np.diff(at.offsets.to_numpy()), at.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            begins = np.concatenate(([0], np.cumsum(sizes)))
            for size, (ids, asked) in held.value.items():
                which = np.flatnonzero(sizes == size)
                norm = np.einsum("ij,ij->i", asked, asked)[:, None]
                for start in range(0, len(which), TILE):
                    tile = which[start : start + TILE]
                    x = flat[begins[tile][:, None] + np.arange(size)]
                    near = norm - 2 * (asked @ x.T) + np.einsum("ij,ij->i", x, x)
                    # a border by the product only chooses; distances are then taken exactly
                    border = worst[size]
                    if len(tile) > limit:
                        border = np.minimum(border, np.partition(near, limit - 1, axis=1)[:, limit - 1])
                    q, r = np.nonzero(near <= border[:, None] + SLACK)
                    if len(q):
                        gone = asked[q] - x[r]
                        score = np.round(-np.einsum("ij,ij->i", gone, gone), 6) + 0.0
                        fresh = pd.DataFrame({"q": q, "uid": uid[tile[r]], "score": score})
                        kept[size] = best([fresh, *([kept[size]] if size in kept else [])])
                        full = kept[size].groupby("q")["score"].agg(["size", "min"])
                        last = full["min"].where(full["size"] >= limit).reindex(range(len(ids))).to_numpy()
                        worst[size] = np.where(np.isnan(last), np.inf, -last)
        for size, hits in kept.items():
            asked_by = pa.array(held.value[size][0], pa.int64()).take(pa.array(hits["q"].to_numpy()))
            yield pa.RecordBatch.from_arrays([asked_by, pa.array(hits["uid"].to_numpy(), pa.string()), pa.array(hits["score"].to_numpy())], names=["query_id", "uid", "score"])

    return run


def candidate_limit(n: int, multiplier: int = 3, cap: int = 100) -> int:
    return min(max(n * max(multiplier, 1), n), cap)


def rrf(vector_hits: DataFrame, bm25_hits: DataFrame, limit: int = 10, k: int = RRF_K, vector_weight: float = 1.0, bm25_weight: float = 1.0) -> DataFrame:
    """Reciprocal rank fusion: hits of either list, one row a (query, uid), both ranks kept."""
    k = max(k, 1)
    v = vector_hits.select("query_id", "uid", "vector_rank", F.lit(None).cast("int").alias("bm25_rank"))
    b = bm25_hits.select("query_id", "uid", F.lit(None).cast("int").alias("vector_rank"), "bm25_rank")
    both = v.unionByName(b).groupBy("query_id", "uid").agg(F.max("vector_rank").alias("vector_rank"), F.max("bm25_rank").alias("bm25_rank"))
    share = lambda w, rank: F.coalesce(F.lit(w) / (F.lit(float(k)) + F.col(rank)), F.lit(0.0))
    score = F.round(share(vector_weight, "vector_rank") + share(bm25_weight, "bm25_rank"), 9)
    return ranked(both.withColumn("score", score), limit, "rank")


def retrieve(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, n: int = 10, mode: str = "hybrid", cells: Cells | None = None) -> DataFrame:
    """Hits of every query (``query_id, query, embedding``) as ``query_id, uid, score, vector_rank,
    bm25_rank, rank``. Blank queries and n below one give nothing; an unknown mode is a
    ``ValueError``, and no index (None for ``chunks`` or ``vectors`` that the mode needs) a
    ``LookupError``. With ``cells`` (of ``neighbours.fit``) vectors are searched approximately."""
    if mode not in ("vector", "bm25", "hybrid"):
        raise ValueError(f"unknown mode: {mode}")
    if (chunks is None and mode != "vector") or (vectors is None and mode != "bm25"):
        raise LookupError("there is no index yet; build one first")
    asked = queries.where(F.trim(F.coalesce("query", F.lit(""))) != "")
    if n <= 0:
        asked = asked.limit(0)
    none = F.lit(None).cast("int")
    depth = candidate_limit(n) if mode == "hybrid" else n
    if mode != "bm25":
        points = asked.select("query_id", "embedding")
        v = search(indexed(vectors, cells), points, cells, depth) if cells else vector_topk(vectors, points, depth)
        if mode == "vector":
            return v.select("query_id", "uid", "score", "vector_rank", none.alias("bm25_rank"), F.col("vector_rank").alias("rank"))
    b = bm25_topk(chunks, asked.select("query_id", "query"), depth)
    if mode == "bm25":
        return b.select("query_id", "uid", "score", none.alias("vector_rank"), "bm25_rank", F.col("bm25_rank").alias("rank"))
    return rrf(v, b, n).select("query_id", "uid", "score", "vector_rank", "bm25_rank", "rank")


def compared(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, n: int = 10) -> dict[str, DataFrame]:
    """Hits of the modes vector and hybrid, for ``evaluate``: vectors are searched once, as deep as
    fusion needs, and those hits (so many a query) are kept for both."""
    asked = queries.where(F.trim(F.coalesce("query", F.lit(""))) != "")
    depth = candidate_limit(n)
    v = vector_topk(vectors, asked.select("query_id", "embedding"), depth).persist()
    b = bm25_topk(chunks, asked.select("query_id", "query"), depth)
    alone = v.where(F.col("vector_rank") <= n).withColumn("rank", F.col("vector_rank"))
    return {"vector": alone, "hybrid": rrf(v, b, n)}


def formatted(hits: DataFrame, chunks: DataFrame, hybrid: bool = True) -> DataFrame:
    """One line a hit: file, start line (0 if chunks have none), provenance, snippet."""
    start = F.coalesce("start_line", F.lit(0)).cast("string") if "start_line" in chunks.columns else F.lit("0")
    # a text's first characters are taken before the join, which would shuffle and sort whole texts
    got = hits.join(chunks.select("uid", "file", start.alias("_start"), snippet(F.col("document")).alias("_text")), "uid", "left")
    said = F.concat_ws(
        ", ",
        F.format_string("RRF:%.4f", "score") if hybrid else F.lit(None).cast("string"),
        F.when(F.col("vector_rank").isNotNull(), F.concat(F.lit("vector#"), F.col("vector_rank").cast("string"))),
        F.when(F.col("bm25_rank").isNotNull(), F.concat(F.lit("BM25#"), F.col("bm25_rank").cast("string"))),
    )
    said = F.when(said == "", "unknown").otherwise(said)
    place = F.concat(F.coalesce("file", F.lit("")), F.lit(":"), F.coalesce("_start", F.lit("0")))
    return got.select("query_id", "rank", F.concat(place, F.lit(" ("), said, F.lit(") | "), F.coalesce("_text", F.lit(""))).alias("line"))


def report(hit_lines: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, report``: a query's header and its lines by rank, or that nothing was found.

    A query has as many lines as it asked for hits, so the list of each is bounded.
    """
    per = hit_lines.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "line"))).alias("found"))
    body = F.array_join(F.transform("found", lambda x: F.concat(F.lit("\n  "), x["line"])), "")
    some = F.concat(F.format_string("%d results:", F.size("found")), body)
    none = F.concat(F.lit("no results for '"), F.coalesce("query", F.lit("")), F.lit("'"))
    return queries.select("query_id", "query").join(per, "query_id", "left").select("query_id", F.when(F.col("found").isNull(), none).otherwise(some).alias("report"))


def matches(hits: DataFrame, files: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``query_id, label, rank``: labels met by a hit's uid or file, by two equi joins."""
    top = hits.where(F.col("rank") <= k).join(files.select("uid", "file"), "uid", "left")
    by = lambda c: top.join(wanted, (top["query_id"] == wanted["query_id"]) & (top[c] == wanted["label"])).select(top["query_id"], "label", "rank")
    return by("uid").union(by("file")).distinct()


def valid_items(items: DataFrame) -> DataFrame:
    """``query_id, query, relevant``: items with a query and a relevant label, each label once."""
    clean = items.select("query_id", "query", F.array_distinct(F.filter("relevant", lambda x: F.trim(x) != "")).alias("relevant"))
    return clean.where((F.trim("query") != "") & (F.size("relevant") > 0))


def evaluate(modes: dict[str, DataFrame], files: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``mode, n_queries, recall, mrr`` over valid items (``query_id, query, relevant``); none is a
    ``ValueError``."""
    clean = valid_items(items)
    if clean.isEmpty():
        raise ValueError("no valid query to evaluate")
    wanted = clean.select("query_id", F.explode("relevant").alias("label"))
    out = None
    for mode, hits in modes.items():
        per = matches(hits, files, wanted, k).groupBy("query_id").agg(F.countDistinct("label").alias("met"), F.min("rank").alias("first"))
        per = clean.join(per, "query_id", "left").select(
            F.lit(mode).alias("mode"),
            (F.coalesce("met", F.lit(0)) / F.size("relevant")).alias("recall"),
            F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
        )
        out = per if out is None else out.unionByName(per)
    return out.groupBy("mode").agg(F.count("*").alias("n_queries"), F.round(F.avg("recall"), 9).alias("recall"), F.round(F.avg("mrr"), 9).alias("mrr"))
