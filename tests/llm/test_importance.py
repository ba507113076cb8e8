import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tamarack.llm import importance
from tamarack.llm.common import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def bucket(f):
    return zlib.crc32(f.encode()) % 10000


def brute(docs, target):
    """Rows (doc_id, n_features, weight, score, rank) of every (doc_id, text), hashing each occurrence."""
    s = Counter(bucket(f) for _, x in docs for f in features(x)[1])
    t = Counter(bucket(f) for x in target for f in features(x)[1])
    gain = [math.floor(1000 * math.log((t[k] + 1) * (s.total() + 10000) / ((s[k] + 1) * (t.total() + 10000)))) for k in range(10000)]
    rows = []
    for i, x in docs:
        w, fs = features(x)
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)])
    best = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    rank = {id(r): k + 1 for k, r in enumerate(best[: 25 * len(best) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=repr)


def held(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_equals_brute_force(spark, sf):
    docs, target = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()])
    assert held(importance.resample(docs, target)) == want


def test_odd_cases_in_small_blocks_and_parts(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(importance, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(importance, "PART_BYTES", 4_000)
    monkeypatch.setattr(importance, "PIECE", 700)
    target = spark.createDataFrame([("The CAT of the house",), (None,), ("",)], "text string")
    docs = odd_docs.repartition(3)
    got = importance.resample(docs, target)
    assert held(got) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], ["The CAT of the house"])


def test_empty_tables(spark, no_docs, odd_docs):
    target = spark.createDataFrame([], "text string")
    assert importance.resample(no_docs, target).count() == 0
    assert held(importance.resample(odd_docs, target)) == brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()], [])


def test_words_are_cut_alike_at_any_piece(monkeypatch):
    text = ("Ä1 b-C\x7f" + "x" * 900 + " é\n" + "Zz" * 300).encode()
    whole = [w for some in importance.words(text) for w in some]
    monkeypatch.setattr(importance, "PIECE", 64)
    assert [w for some in importance.words(text) for w in some] == whole == [w.encode() for w in features(text.decode())[0]]


@pytest.mark.parametrize("name", ["row", "weight", "a.b"])
def test_draw_keeps_whole_documents_with_clashing_names(spark, sf, name):
    docs = table(spark, sf, "documents").withColumn(name, F.lit("mine"))
    target = table(spark, sf, "benchmark")
    drawn = importance.draw(docs, target)
    ids = {r["doc_id"] for r in importance.resample(docs, target).where("rank is not null").collect()}
    assert drawn.columns == docs.columns
    rows = {r["doc_id"]: r.asDict() for r in drawn.collect()}
    assert set(rows) == ids and rows == {r["doc_id"]: r.asDict() for r in docs.collect() if r["doc_id"] in ids}


def test_each_string_of_a_part_is_hashed_once(monkeypatch):
    import pandas as pd

    two = []
    for number in range(2):
        block = importance.Block()
        for text in (b"a b a b", b"b c"):
            block.add(text)
        two += [{"block": number, **x} for x in block.closed(1)[1]]
    seen = []
    monkeypatch.setattr(importance.zlib, "crc32", lambda x, f=zlib.crc32: (seen.append(bytes(x)), f(x))[1])
    out = importance._part(pd.DataFrame(two))
    assert sorted(seen) == [b"a", b"a b", b"b", b"b a", b"b c", b"c"]
    assert sum(out["s"].iloc[0]) == 2 * 10 and out["block"].tolist() == [-1, 0, 1]
