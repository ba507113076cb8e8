import re
from collections import Counter

import pytest

import corpus_pipeline
from tamarack.llm import pii, toxicity
from tamarack.llm.common import keep
from test_jaccard import shingle_set
from test_mixing import targets
from test_packing import check
from test_pii import brute as spans


@pytest.fixture(scope="module")
def steps(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(keep(stage(spark, out[-1], sf), f"test-{name}"))
    return out


def test_columns_stay_until_packing(steps):
    assert all(x.columns == steps[0].columns for x in steps[:-1])


def test_toxic_documents_go_and_others_stay(spark, steps):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    find = toxicity.score_column(*toxicity.model(steps[0], labels))
    bad = {r["doc_id"] for r in steps[0].withColumn("s", find("text")).where("s >= 0.5").collect()}
    assert {r["doc_id"] for r in steps[1].collect()} == {r["doc_id"] for r in steps[0].collect()} - bad


def test_one_document_of_each_group_stays(steps):
    rows = sorted((r["doc_id"], shingle_set(r["text"], 5)) for r in steps[1].collect())
    root = {i: i for i, _ in rows}

    def top(x):
        return x if root[x] == x else top(root[x])

    for n, (i, s) in enumerate(rows):
        for j, t in rows[n + 1 :]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    assert sorted(r["doc_id"] for r in steps[2].collect()) == sorted({top(i) for i, _ in rows})


def test_no_base_span_is_left_and_clean_texts_are_untouched(steps):
    before = {r["doc_id"]: r["text"] for r in steps[2].collect()}
    for r in steps[3].collect():
        text = before[r["doc_id"]]
        assert not spans(r["text"])[2]
        if not any(re.search(p, text) for p in (r"@", r"\d", r"token")):
            assert r["text"] == text
    assert len(pii.KINDS) == 7


def test_mixed_words_meet_targets(steps):
    before, after = {}, {}
    for r in steps[3].collect():
        before[r["source"]] = before.get(r["source"], 0) + len(r["text"].split())
    for r in steps[4].collect():
        after[r["source"]] = after.get(r["source"], 0) + len(r["text"].split())
    for s, goal in targets(before).items():
        assert abs(after.get(s, 0) - goal) <= 3


def test_packing_holds_every_id_once(steps):
    check(steps[4], steps[5].collect())


def test_run_gives_the_same_rows(spark, steps):
    run = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    # where tails are cut depends on the tasks' ranges, so rows are compared a document
    def whole(rows):
        out = Counter()
        for r in rows:
            out[r["doc_id"], r["doc_tokens"]] += r["length"]
        return out

    full = lambda rows: sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in rows if r["length"] == 1024 and r["sequence_id"] % 2 == 0)
    a, b = run.collect(), steps[5].collect()
    assert whole(a) == whole(b) and full(a) == full(b)


def test_a_chain_of_stages_takes_odd_rows(spark, odd_docs, no_docs):
    """Clashing names, nulls and empty tables pass through all stages but the last."""
    sf = "/root/testdata/sf0.001"
    more = ["spans", "row", "size", "label", "a.b", "__text", "__score", "component_id", "n", "part", "target"]
    for docs in (odd_docs, no_docs):
        docs = docs.selectExpr("*", *[f"'{c}' as `{c}`" for c in more])
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = keep(stage(spark, docs, sf), f"test-odd-{name}")
            assert docs.columns == [*odd_docs.columns, *more]
            assert all(docs.where(f"`{c}` <> '{c}'").isEmpty() for c in more)
        rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
        assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.select("doc_id").collect()}
