import math
import re
from collections import Counter

import numpy as np
import pytest
from tamarack.llm import search


def terms(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("(?:[a-z0-9]|[^\x00-\x7f])+", text)


def brute(docs, k=search.TOP, every=search.EVERY):
    tf = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n, mean = len(tf), sum(x for *_, x in tf) / max(1, len(tf))
    df = Counter(w for _, c, _ in tf for w in c)
    out = []
    for q, asked, _ in tf:
        if q is None or q % every:
            continue
        scored = []
        for i, c, long in tf:
            s = 0.0
            for w, m in asked.items():
                if w in c:
                    idf = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
                    s += m * idf * c[w] * (search.K1 + 1) / (c[w] + search.K1 * (1 - search.B + search.B * long / mean))
            if s > 0 and i is not None:
                scored.append((-s, i))
        out += [(q, i, r + 1, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return out


def compare(docs, found):
    got = {(r["query"], r["rank"]): (r["doc_id"], r["score"]) for r in found}
    want = brute([(r["doc_id"], r["text"]) for r in docs])
    assert len(got) == len(want)
    for q, i, rank, s in want:
        doc, score = got[q, rank]
        assert abs(score - s) < 1e-7 * max(1, s)
        assert doc == i or sum(abs(x[3] - s) < 1e-7 * max(1, s) for x in want if x[0] == q) > 1


def test_fixture(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    monkeypatch.setattr(search, "QUERIES", 1)  # several blocks
    compare(docs.collect(), search.search(docs).collect())


def test_ties_repeats_and_odd_rows(spark, odd_docs, no_docs):
    rows = [(0, "a b c a"), (100, "B c, d"), (1, "a b"), (2, "a b"), (3, None), (4, ""), (200, None), (None, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    compare(docs.collect(), search.search(docs).collect())
    assert search.search(no_docs).count() == 0 and search.search(odd_docs).count() == 0


def shard_of(rng, n, monkeypatch, common):
    monkeypatch.setattr(search, "COMMON", common)
    monkeypatch.setattr(search, "TERMS", 1)
    row = np.repeat(np.arange(n), 20)
    term = rng.zipf(1.4, len(row)).astype(np.uint64)
    return row, term, search.Shard([np.arange(n)[::-1], term, row], 20.0)


@pytest.mark.parametrize("common", [0, 4])  # without and with dense lists
def test_pivot_is_exact_and_skips_postings(monkeypatch, common):
    rng = np.random.default_rng(2)
    n = 5000
    row, term, shard = shard_of(rng, n, monkeypatch, common)
    asked = [np.unique(rng.zipf(1.4, 12).astype(np.uint64)) for _ in range(70)]  # more than TOGETHER
    queries = [(t, rng.random(len(t)) * np.log(1 + t) + 0.1) for t in asked]
    read = 0
    for (asked, weight), (ids, scores, n_read) in zip(queries, shard.top(queries, 10), strict=True):
        full = np.zeros(n)
        for t, w in zip(asked, weight, strict=True):
            tf = np.bincount(row[term == t], minlength=n)
            full += w * tf * 2.5 / (tf + 1.5) * (tf > 0)
        order = np.lexsort((np.arange(n)[::-1], -np.round(full, 9)))[:10]
        order = order[full[order] > 0]
        assert np.allclose(scores, full[order]) and len(scores) == len(order)
        assert set(np.arange(n)[::-1][full > full[order[-1]] + 1e-9]) <= set(ids)
        read += n_read
    at = [np.searchsorted(shard.terms, t) for t, _ in queries]
    at = [a[(a < len(shard.terms)) & (shard.terms[np.minimum(a, len(shard.terms) - 1)] == t)] for a, (t, _) in zip(at, queries, strict=True)]
    lists = sum(int((shard.post[a + 1] - shard.post[a])[shard.column[a] < 0].sum()) for a in at)
    assert read < 0.8 * lists


def test_blocks_rows_and_equal_documents():
    """Every posting lies in its block under the block's maximum; equal documents score equally,
    whichever shard holds them, long rows (searched) and short ones (read) alike."""
    rng = np.random.default_rng(5)
    texts = [rng.integers(1, 9000, 6000).astype(np.uint64), rng.integers(1, 50, 30).astype(np.uint64)]
    asked = np.unique(rng.integers(1, 9000, 300).astype(np.uint64))
    weight = rng.random(len(asked))
    seen = []
    for others in (0, 1, 500):
        docs = [*texts, *(rng.integers(1, 9000, 40).astype(np.uint64) for _ in range(others))]
        shard = search.Shard([np.arange(len(docs)), np.concatenate(docs), np.repeat(np.arange(len(docs)), [len(d) for d in docs])], 40.0)
        for t in range(len(shard.terms)):
            for e in range(shard.entry[t], shard.entry[t + 1]):
                own = slice(shard.post[t], shard.post[t + 1])
                held = shard.impact[own][shard.doc[own] // search.BLOCK == shard.block[e]]
                assert len(held) and held.max() == shard.block_most[e] <= shard.most[t]
        at = np.searchsorted(shard.terms, asked)
        ok = shard.terms[np.minimum(at, len(shard.terms) - 1)] == asked
        where = np.array([np.flatnonzero(shard.ids == i)[0] for i in (0, 1)])
        seen.append(tuple(shard._score(where, at[ok], weight[ok])))
    assert seen[0] == seen[1] == seen[2] and np.diff(shard.own).max() > search.LONG_ROW
