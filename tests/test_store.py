import re

import pytest
from pyspark.sql import functions as F

from tamarack.operators import retrieval
from tamarack.operators.postings import Postings, counted
from tamarack.sources.store import Store

ROW = "uid string, file string, document string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_only_touched_parts_are_written_again(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"), parts=8)
    with pytest.raises(LookupError):
        store.read()
    first = spark.createDataFrame([(f"{f}:{i}", f"f{f}", "old") for f in range(30) for i in range(2)], ROW)
    none = spark.createDataFrame([], "file string")
    assert len(store.update(none, first)) == 8 and rows(store.read()) == rows(first)
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "t" / "data").rglob("*.parquet")}
    before = files()
    fresh = spark.createDataFrame([("3:0", "f3", "new"), ("x:0", None, "nameless")], ROW)
    touched = store.update(spark.createDataFrame([("f7",), ("unknown",)], "file string"), fresh)
    assert 0 < len(touched) < 5
    assert rows(store.read()) == rows(first.where("file not in ('f3', 'f7')").union(fresh))
    after = files()
    assert all(after[p] == t for p, t in before.items())
    named = {(v, p) for p, v in store.manifest()["parts"].items()}
    assert all((2 if int(p) in touched else 1) == v for v, p in named)
    store.vacuum()
    assert rows(store.read()) == rows(first.where("file not in ('f3', 'f7')").union(fresh))
    assert len(files()) < len(after)


def test_an_unfinished_update_is_not_seen_and_can_be_repeated(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "t"), parts=4)
    one, two = spark.createDataFrame([("a", "a", "1")], ROW), spark.createDataFrame([("b", "b", "2")], ROW)
    none = spark.createDataFrame([], "file string")
    store.update(none, one)
    with monkeypatch.context() as m:
        m.setattr(Store, "_commit", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.update(none, two)
    assert rows(store.read()) == rows(one)
    store.update(none, two)
    assert rows(store.read()) == rows(one.union(two))
    store.update(one.union(two).select("file"), two.limit(0))
    assert rows(store.read()) == []


def _documents(spark, sf="/root/testdata/sf0.001"):
    return retrieval.documents_as_chunks(spark.read.parquet(f"{sf}/documents.parquet"))


def _asked(spark):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    return items.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def test_three_builds_answer_as_one_built_afresh(spark, tmp_path):
    docs, asked = _documents(spark), _asked(spark)
    number = F.col("uid").cast("long")
    index = Postings(spark, str(tmp_path / "i"), folders=8)
    with pytest.raises(LookupError):
        index.search(asked)
    old = docs.withColumn("document", F.when(number % 3 == 1, F.concat(F.lit("stale "), F.reverse("document"))).otherwise(F.col("document")))
    index.add(old.where(number % 2 == 0))
    index.add(old.where(number % 2 == 1))
    gone = old.where(number % 3 == 1)
    index.add(docs.where((number % 3 == 1) & (number % 5 > 0)), gone)
    there = docs.where(~((number % 3 == 1) & (number % 5 == 0)))
    want = rows(retrieval.bm25_topk(there, asked).select("query_id", "uid", "score", "bm25_rank"))
    assert rows(index.search(asked).select("query_id", "uid", "score", "bm25_rank")) == want
    index.compact()
    assert index.builds() == [4] and rows(index.search(asked).select("query_id", "uid", "score", "bm25_rank")) == want
    index.add(docs.limit(0), there)
    assert index.search(asked).count() == 0


def test_a_build_without_totals_is_not_there(spark, tmp_path, monkeypatch):
    docs, asked = _documents(spark), _asked(spark)
    index = Postings(spark, str(tmp_path / "i"), folders=4)
    index.add(docs.where("uid < '5'"))
    want = rows(index.search(asked))
    with monkeypatch.context() as m:
        write = Postings._write
        m.setattr(Postings, "_write", lambda self, b, name, df: 1 / 0 if name == "totals" else write(self, b, name, df))
        with pytest.raises(ZeroDivisionError):
            index.add(docs.where("uid >= '5'"))
    assert rows(index.search(asked)) == want
    index.add(docs.where("uid >= '5'"))
    assert rows(index.search(asked).select("query_id", "uid", "score", "bm25_rank")) == rows(retrieval.bm25_topk(docs, asked).select("query_id", "uid", "score", "bm25_rank"))


def test_a_search_reads_its_terms_folders(spark, tmp_path):
    index = Postings(spark, str(tmp_path / "i"), folders=16)
    index.add(_documents(spark))
    one = spark.createDataFrame([(1, "the")], "query_id long, query string")
    plan = index.search(one)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan or "PartitionFilters: [(folder" in plan
    assert "document" not in plan


def test_a_search_shuffles_postings_not_scores(spark, tmp_path):
    """A chunk's postings meet once, by chunk: nothing is dealt out by query and chunk, nor when a build counts terms."""
    index = Postings(spark, str(tmp_path / "i"), folders=4)
    index.add(_documents(spark))
    plan = index.search(_asked(spark))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(uid#\d+", plan) and not re.search(r"hashpartitioning\(query_id#\d+L?, uid", plan), plan


def test_runs_of_sorted_tokens_are_counted(spark):
    df = spark.createDataFrame([(["b", "a", "b", "c", "b"],), ([],), (["x"],)], "tokens array<string>")
    got = [[tuple(x) for x in r[0]] for r in df.select(counted(F.col("tokens"))).collect()]
    assert got == [[("a", 1), ("b", 3), ("c", 1)], [], [("x", 1)]]
