import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tamarack.operators import retrieval

CHUNKS = [("a:1", "auth.py", "login user password login"), ("b:1", "db.py", "open database"), ("c:1", "ui.py", "user button"), ("d:1", None, None)]


def frames(spark, queries=((1, "user login login"), (2, "  "), (3, "zzz"))):
    chunks = spark.createDataFrame(CHUNKS, "uid string, file string, document string")
    vectors = spark.createDataFrame([("a:1", [1.0, 0.0]), ("b:1", [0.0, 1.0]), ("c:1", [0.0, 1.0]), ("e:1", None)], "uid string, embedding array<float>")
    asked = spark.createDataFrame([(i, q, [0.0, 1.0]) for i, q in queries], "query_id long, query string, embedding array<float>")
    return chunks, vectors, asked


def test_bm25_against_the_formula(spark):
    chunks, vectors, asked = frames(spark)
    got = {(r["query_id"], r["uid"]): r["score"] for r in retrieval.bm25_scores(chunks, asked).collect()}
    docs = {u: re.findall("[a-z]+", f"{f or ''} {d or ''}") for u, f, d in CHUNKS}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(t for d in docs.values() for t in set(d))
    for q, words in ((1, "user login login"),):
        for u, d in docs.items():
            tf, s = Counter(d), 0.0
            for t in re.findall("[a-z]+", words):
                if tf[t]:
                    s += math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(d) / avg))
            assert abs(got.get((q, u), 0.0) - s) < 1e-6
    assert not [k for k in got if k[0] != 1]


def test_vector_ties_go_by_uid(spark):
    _, vectors, asked = frames(spark)
    rows = retrieval.vector_topk(vectors, asked.where("query_id = 1"), 2).orderBy("vector_rank").collect()
    assert [(r["uid"], r["score"]) for r in rows] == [("b:1", 0.0), ("c:1", 0.0)]


def test_fusion_lifts_what_both_lists_have_and_zero_weight_keeps_a_hit(spark):
    v = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id long, uid string, vector_rank int")
    b = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "query_id long, uid string, bm25_rank int")
    rows = retrieval.rrf(v, b).orderBy("rank").collect()
    assert [r["uid"] for r in rows] == ["b", "a", "c"] and abs(rows[0]["score"] - (1 / 62 + 1 / 61)) < 1e-8
    assert retrieval.rrf(v, b, bm25_weight=0.0).where("uid = 'c' and score = 0").count() == 1


def test_modes_blank_queries_and_errors(spark):
    chunks, vectors, asked = frames(spark)
    for mode in ("vector", "bm25", "hybrid"):
        hits = retrieval.retrieve(chunks, vectors, asked, 10, mode)
        assert hits.columns == ["query_id", "uid", "score", "vector_rank", "bm25_rank", "rank"]
        assert hits.where("query_id = 2").count() == 0
    assert retrieval.retrieve(chunks, vectors, asked, 0).count() == 0
    with pytest.raises(ValueError):
        retrieval.retrieve(chunks, vectors, asked, 10, "other")
    assert retrieval.candidate_limit(10) == 30 and retrieval.candidate_limit(200) == 100 and retrieval.candidate_limit(5, 0) == 5


def test_evaluation_counts_misses_and_matches_uid_or_file(spark):
    chunks, _, _ = frames(spark)
    hits = spark.createDataFrame([(1, "a:1", 1), (1, "c:1", 2)], "query_id long, uid string, rank int")
    items = spark.createDataFrame([(1, "q", ["auth.py", "missing", " "]), (2, "q", ["b:1"]), (3, " ", ["b:1"]), (4, "q", [" "])], "query_id long, query string, relevant array<string>")
    r = retrieval.evaluate({"m": hits}, chunks, items).first()
    assert (r["n_queries"], r["recall"], r["mrr"]) == (2, 0.25, 0.5)


def test_reports_name_start_lines_and_empty_results(spark):
    chunks, vectors, asked = frames(spark)
    lined = chunks.withColumn("start_line", F.lit(7))
    hits = retrieval.retrieve(chunks, vectors, asked, 1, "bm25")
    got = {r["query_id"]: r["report"] for r in retrieval.report(retrieval.formatted(hits, lined, False), asked).collect()}
    assert got[1] == "1 results:\n  auth.py:7 (BM25#1) | login user password login"
    assert got[2] == "no results for '  '" and got[3] == "no results for 'zzz'"


def test_missing_index_and_no_valid_item_are_errors(spark):
    _, vectors, asked = frames(spark)
    with pytest.raises(LookupError):
        retrieval.retrieve(None, vectors, asked)
    items = spark.createDataFrame([(1, " ", ["a"])], "query_id long, query string, relevant array<string>")
    with pytest.raises(ValueError, match="no valid query"):
        retrieval.evaluate({}, vectors, items)


def test_nearest_of_many_batches_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "TILE", 16)
    rng = np.random.default_rng(3)
    points = np.repeat(rng.normal(size=(60, 8)), 5, axis=0).astype(np.float32)
    rows = [(f"{i:03d}", [float(x) for x in p]) for i, p in enumerate(points)] + [("odd", [1.0])]
    vectors = spark.createDataFrame(rows, "uid string, embedding array<float>").repartition(3)
    asked = spark.createDataFrame([(i, rows[i * 7][1]) for i in range(20)], "query_id long, embedding array<float>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    got = {(r["query_id"], r["vector_rank"]): r["uid"] for r in retrieval.vector_topk(vectors, asked, 7).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for i in range(20):
        d = ((points.astype(float) - points[i * 7].astype(float)) ** 2).sum(1)
        best = sorted(range(len(points)), key=lambda j: (round(d[j], 6), f"{j:03d}"))[:7]
        assert [got[i, k + 1] for k in range(7)] == [f"{j:03d}" for j in best]


def test_bm25_has_a_task_for_every_so_many_scores(spark, monkeypatch):
    """The number of tasks follows chunks times queries, not the session's setting."""
    monkeypatch.setattr(retrieval, "SCORES", 10)
    chunks = spark.createDataFrame([(str(i), None, f"alpha w{i}") for i in range(100)], "uid string, file string, document string")
    queries = spark.createDataFrame([(i, "alpha") for i in range(3)], "query_id long, query string")
    got = retrieval.bm25_topk(chunks, queries, 2)
    assert "hashpartitioning(uid" in (plan := got._jdf.queryExecution().toString()) and ", 30)" in plan
    assert [(r["query_id"], r["uid"]) for r in got.orderBy("query_id", "bm25_rank").collect()] == [(q, u) for q in range(3) for u in ("0", "1")]
