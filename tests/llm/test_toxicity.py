import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tamarack.llm import toxicity as tox


@pytest.fixture(scope="module")
def trained(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    return docs, labels, tox.model(docs, labels)


def test_char_counts_cover_every_text(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, None), (3, "")], "doc_id long, text string")
    counts = tox.char_counts(docs).reshape(tox.SIZE, tox.SIZE, tox.SIZE)
    assert counts[1, 2, 3] == 1 and counts[0, 0, 1] == 1 and counts[2, 3, 0] == 1


def test_obfuscated_words_are_restored(trained):
    _, _, (words, _, _, cost) = trained
    assert "idiot" in words and "moron" in words
    find = tox.Finder(words, [], cost)
    for spelled in ("1d10t", "id!ot", "i d i o t", "i.d.i.o.t", "idiiiot", "m0r0n", "m-o-r-o-n", "st00pid"[:0] + "stup1d", "tr@sh", "l0ser"):
        assert find(f"the reand {spelled}, of th"), spelled
    assert not find("the reand of the 12 3rd 555-7713 a b c item")


def test_held_out_accuracy_and_fold(trained):
    docs, labels, _ = trained
    rows = tox.classify(docs, labels).join(labels, "doc_id").collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1
    hits = sum(r["predicted"] for r in rows if r["toxic"])
    assert hits >= 0.9 * sum(r["toxic"] for r in rows)
    assert sum(r["predicted"] for r in rows if not r["toxic"]) <= 0.01 * len(rows)


def test_held_out_recall_and_precision_in_every_language(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = tox.classify(docs, labels).where("held_out").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    for lang, least in ((None, 0.9), ("en", 0.88), ("de", 0.8), ("fr", 0.9), ("es", 0.9)):
        some = [r for r in rows if lang in (None, r["lang"])]
        hits = sum(r["predicted"] for r in some if r["toxic"])
        assert hits >= least * sum(r["toxic"] for r in some), lang
        assert hits >= 0.9 * sum(r["predicted"] for r in some), lang


def test_stems_count_from_two_words_on_plainly_or_restored(trained):
    _, _, (_, _, _, cost) = trained
    find = tox.Finder(["idiot"], ["achlich"], cost)
    assert find("der achlichtz und achlichver.") == {1} == find("achlichtz (4chl!chver)") == find("a.c.h.l.i.c.h.t.z der achlichtz")
    assert not find("der achlichtz und") and not find("achlich achlich") and not find("xachlichtz yachlichtz")
    assert not find("der achlliichtz und")  # one word, however it is read
    assert find("1d10t achlichtz") == {0}


def test_stems_are_counted_and_chosen(spark):
    df = spark.createDataFrame([(["achlich", "achlichx", "achlichyy", "abc", "abcde", "abcdf"],), ([],)], "w array<string>")
    got = [sorted(r[0]) for r in df.select(tox.twice_begun(F.col("w"))).collect()]
    assert got == [["abcd", "achl", "achli", "achlic", "achlich"], []]
    rows = [("sure", 0, 9, 0), ("even", 0, 9, 70), ("rare", 0, 2, 0), ("stem", 4, 8, 0), ("stems", 5, 8, 0), ("other", 5, 9, 0)]
    counted = spark.createDataFrame(rows, "w string, kind int, pos long, neg long")
    assert sorted(tox.choose(counted, 20, 180)) == ["other", "stems", "sure"]
    assert abs(tox.unlikely(3, 3, 0.1) - 0.001) < 1e-12 and abs(tox.unlikely(0, 5, 0.3) - 1) < 1e-9


def test_scores_depend_on_the_text_alone(trained):
    docs, labels, model = trained
    score = tox.score_column(*model)
    two = docs.limit(20).select("text").withColumn("text", F.concat("text", F.lit(" scum clown")))
    assert {r["s"] >= 0.5 for r in two.select(score("text").alias("s")).collect()} == {True}


def test_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(2, 1, 0), (4, 1, 1), (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    out = tox.classify(odd_docs, labels)
    assert out.count() == odd_docs.count() and out.where("score is null").count() == 0
    assert tox.classify(no_docs, labels.limit(0)).count() == 0
    assert tox.reject(odd_docs, labels.limit(0)).columns == odd_docs.columns


def test_decode_is_the_cheapest_path():
    rng = np.random.default_rng(1)
    cost = rng.random((tox.SIZE,) * 3).astype(np.float32)
    best = None
    spot = "a1b0c"
    import itertools

    for path in itertools.product(*tox.lattice(spot)):
        text, total = "".join(x for x, _ in path), sum(c for _, c in path)
        a = b = 0
        for c in text:
            total += float(cost[a, b, tox._INDEX[c]])
            a, b = b, tox._INDEX[c]
        total += float(cost[a, b, 0])
        best = min(best or (total, text), (total, text))
    assert tox.decode(spot, cost) == best[1]


def test_long_repetitions_are_one_step(trained):
    _, _, (words, _, _, cost) = trained
    find = tox.Finder([*words, "stupid"], [], cost)
    for n in (20, 45, 5000):
        assert find("you are st" + "u" * n + "pid"), n
        assert find("you are id" + "i" * n + "ot"), n
    assert not find("ab1c" * 50_000)


def test_signs_at_edges_doubled_and_mixed_separators(trained):
    _, _, (words, _, _, cost) = trained
    find = tox.Finder([*{*words, "trash", "loser"}], [], cost)
    spelled = ("idio7", "tra5#", "1d107", "1053r", "!diot", "(tra5#!!", "i/d/i/o/t", "i  d  i  o  t", "i d ! o t", "i-d_i o.t", "i*d*i*o*t", "iidiioott")
    for x in (*spelled, "you are a i d i o t", "i d i o t   m o r o n"):
        assert find(f"the reand {x}, of th"), x
    assert len(find("i d i o t   m o r o n")) == 2
    for x in ("letter all 3rd a1 b2 #tag well!", "p a s s e d  b y", "x | y | z + 1 | 2", "A. B. C. - d", "_ _ _ * * * ! ! !"):
        assert not find(x), x


def test_stretches_of_the_lattice_are_those_of_brute_force(trained):
    _, _, (_, _, _, cost) = trained
    words = ["idiot", "scum", "trash", "tool"]
    find = tox.Finder(words, [], cost)
    rng = np.random.default_rng(3)
    for _ in range(300):
        spot = "".join(rng.choice(list("idotscumtrah105!*$7#"), rng.integers(3, 9)))
        spot = spot[:1] + rng.choice(words)[:5].replace("i", "1") + spot[1:3] if rng.random() < 0.5 else spot
        if not any(c in tox._INDEX for c in spot):
            continue
        at = tox.cuts(spot)
        letters = [k for k, i in enumerate(at[:-1]) if spot[i] in tox._INDEX]
        subs = {spot[at[a] : at[b]] for a in range(letters[0] + 1) for b in range(letters[-1] + 1, len(at))}
        want = {tox.decode(x, cost) for x in subs} & set(words)
        assert want <= {words[i] for i in find.token(spot)}, spot
