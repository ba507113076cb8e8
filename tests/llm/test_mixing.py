import math
import re

from pyspark.sql import functions as F
from tamarack.llm import mixing


def sizes(docs):
    return [(r["doc_id"], r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in docs.collect()]


def targets(per, weights=(5, 2, 1), budget=1.5, most=2):
    """Clamp, share the excess by weight, repeat until none is above."""
    names = sorted(per, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, fixed, open_ = budget * sum(per.values()), {}, set(names)
    while open_:
        left, w = total - sum(fixed.values()), sum(weight[s] for s in open_)
        share = {s: left * weight[s] / w for s in open_}
        over = [s for s in open_ if share[s] > most * per[s]]
        if not over:
            return fixed | share
        for s in over:
            fixed[s] = float(most * per[s])
            open_.remove(s)
    return fixed


def check(docs):
    rows = mixing.taken(mixing.measured(docs)).collect()
    want, per = sizes(docs), {}
    for _, s, n in want:
        per[s] = per.get(s, 0) + n
    goal, took = targets(per), dict.fromkeys(per, 0)
    assert sorted([(r["doc_id"], r["source"], r["size"]) for r in rows], key=repr) == sorted(want, key=repr)
    for r in rows:
        assert math.isclose(r["target"], goal[r["source"]], rel_tol=1e-9, abs_tol=1e-9)
        assert r["source_size"] == per[r["source"]] and 0 <= r["taken"] <= 2 * r["size"]
        took[r["source"]] += r["taken"]
    for s in per:
        assert abs(took[s] - goal[s]) <= 3
    return rows


def test_fixture_meets_targets_and_reruns_agree(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, check(docs))) == sorted(map(key, check(docs.repartition(5))))


def test_hot_and_null_sources_and_odd_rows(spark, odd_docs, no_docs):
    rows = [(i, "a b c " * (i % 9), "hot" if i % 3 else f"s{i % 11}") for i in range(400)] + [(500, "x y", None), (501, "", "empty")]
    check(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    check(odd_docs)
    assert mixing.taken(mixing.measured(no_docs)).count() == 0


def test_mixed_texts_hold_the_taken_words(spark, odd_docs, no_docs):
    rows = [(i, f"w{i} b  c\nd " * (1 + i % 9), f"s{i % 4}", i) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int")
    took = {r["doc_id"]: r["taken"] for r in mixing.taken(mixing.measured(docs)).collect()}
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    got = {i: 0 for i in took}
    whole = {r[0]: r[1] for r in rows}
    for r in out.collect():
        got[r["doc_id"]] += len(r["text"].split())
        assert whole[r["doc_id"]].startswith(r["text"]) and r["extra"] == r["doc_id"]
    assert got == took
    assert mixing.mix(odd_docs).columns == odd_docs.columns and mixing.mix(no_docs).count() == 0
    assert mixing.mix(odd_docs).where(F.col("doc_id") == 1).first()["text"] is None
