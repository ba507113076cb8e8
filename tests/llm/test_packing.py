import zlib
from collections import defaultdict

import numpy as np
from tamarack.llm import packing, tokens


def check(docs, rows, window=1024):
    encode = tokens._library(tokens.FILE)[0]
    want = sorted([(r["doc_id"], encode([r["text"] or ""])[0] + [0]) for r in docs.collect()], key=repr)
    by, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append(r)
    copies = defaultdict(list)
    for i, ids in want:
        copies[i].append(ids)
    for i, each in copies.items():
        assert sum(r["length"] for r in by[i]) == sum(map(len, each))
        for r in by[i]:
            fits = [x for x in each if len(x) == r["doc_tokens"] and zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]]
            assert fits
        if len(each) == 1:
            at = 0
            for r in sorted(by[i], key=lambda r: r["start"]):
                assert r["start"] == at
                at += r["length"]
            assert at == len(each[0])
    padding = 0
    for pieces in seqs.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding == 0


def test_fixture(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(docs, packing.pack(docs).collect())


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs, packing.pack(odd_docs).collect())
    assert packing.pack(no_docs).count() == 0


def test_small_window(spark):
    docs = spark.createDataFrame([(i, "a b c d e f g h i" * (i % 4)) for i in range(40)], "doc_id long, text string")
    check(docs, packing.pack(docs, window=8).collect(), 8)


def test_hilbert_steps_are_unit_steps(monkeypatch):
    monkeypatch.setattr(packing, "BITS", 3)
    grid = np.array([[a, b, c] for a in range(8) for b in range(8) for c in range(8)])
    key = packing.hilbert((grid + 0.5) / 8)
    assert len(set(key.tolist())) == 512
    assert set(np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1).tolist()) == {1}
