import random
import re
from collections import Counter

import numpy as np
import pytest
from tamarack.llm import jaccard_join as join
from tamarack.llm import common, shingles


def shingle_set(text, size=4):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute(docs, percent=85):
    rows = [(i, shingle_set(t)) for i, t in docs]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = {}
    for i, s in rows:
        for x in s:
            where.setdefault(x, []).append((i, s))
    for i, s in rows:
        for j, t in {j: t for x in s for j, t in where[x] if j > i}.items():
            common = len(s & t)
            if 100 * common >= percent * (len(s) + len(t) - common):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted((i, len(s), find(i)) for i, s in rows)


def got(docs):
    return sorted(tuple(r) for r in join.link(docs).select("doc_id", "n_shingles", "component_id").collect() if r["doc_id"] is not None)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_fixture(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert got(docs) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def chain(n, words, edits, rng):
    """Texts that each differ a little from the one before, so only neighbours link."""
    text = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        out.append(" ".join(text))
        for _ in range(edits):
            text[rng.randrange(words)] = f"w{rng.randrange(10**6)}"
    return out


def test_chains_shared_passages_and_small_sets(spark, monkeypatch):
    rng = random.Random(3)
    texts = []
    for words, edits in ((9, 1), (16, 1), (60, 1), (60, 2), (150, 3), (150, 6), (700, 12)):
        texts += chain(25, words, edits, rng)
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"o{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 60))) for _ in range(150)]
    texts += ["", None, "a", "A", "a b", "a b c", "a b c d", "A b c D", "x " * 500]
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    monkeypatch.setattr(join, "DIRECT", 4)  # so that blocks are compared
    monkeypatch.setattr(join, "BLOCK_SETS", 16)
    monkeypatch.setattr(join, "DENSE", 5)
    monkeypatch.setattr(common, "LOOKUP_ROWS", 10)  # so that hot keys are joined apart
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    assert got(spark.createDataFrame(docs, "doc_id long, text string")) == brute(docs)


def test_a_passage_of_unlinked_documents_gives_few_pairs(spark, monkeypatch):
    """Two thousand documents share a passage and nothing else: hardly any two are compared."""
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    docs = [(i, passage + " " + " ".join(f"o{rng.randrange(10**6)}" for _ in range(rng.randrange(20, 60)))) for i in range(2000)]
    compared, blocks = [], []
    verified, blockwise = join.verified, join.blockwise

    def counted(docs, pairs, *rest):
        compared.append(pairs.count())
        return verified(docs, pairs, *rest)

    def counted_blocks(docs, rows, *rest):
        blocks.append(rows.count())
        return blockwise(docs, rows, *rest)

    monkeypatch.setattr(join, "verified", counted)
    monkeypatch.setattr(join, "blockwise", counted_blocks)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(df) == brute(docs)
    assert sum(compared) < 20 * len(docs) and sum(blocks) == 0, (compared, blocks)


@pytest.mark.parametrize("dense", [0, 3, 10**9])
def test_sizes_of_intersections(monkeypatch, dense):
    monkeypatch.setattr(join, "DENSE", dense)
    rng = np.random.default_rng(6)
    made = lambda k: [np.unique(rng.zipf(1.3, rng.integers(1, 60)).astype(np.uint64)) for _ in range(k)]
    xs, ys = made(20), made(31)
    assert join._common(xs, ys).tolist() == [[len(np.intersect1d(a, b)) for b in ys] for a in xs]
    assert join._common([np.array([1], np.uint64)], [np.array([2], np.uint64)]).tolist() == [[0]]


@pytest.mark.parametrize("same", [True, False])
def test_a_forest_connects_what_all_links_do(same):
    rng = np.random.default_rng(7)
    for density in (0.0, 0.01, 0.05, 0.3, 1.0):
        x = rng.permutation(200)[:70]
        y = x if same else rng.permutation(np.setdiff1d(np.arange(200), x))[:90]
        linked = rng.random((len(x), len(y))) < density
        if same:
            linked = np.triu(linked, 1) | np.triu(linked, 1).T
        a, b = join.forest(np.packbits(linked, axis=1), x, y)
        i, j = np.nonzero(linked)
        assert set(zip(a.tolist(), b.tolist())) <= set(zip(x[i].tolist(), y[j].tolist()))

        def parts(a, b):
            root = np.arange(200)
            for p, q in zip(a.tolist(), b.tolist()):
                root[root == root[q]] = root[p]
            return root[:, None] == root[None, :]

        assert (parts(a, b) == parts(x[i], y[j])).all() and len(a) < len(set(x.tolist()) | set(y.tolist()))


def test_a_block_of_near_copies_gives_fewer_links_than_sets(spark, monkeypatch):
    """All pairs of 300 near copies link; comparing them block by block gives one link a set at most."""
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(words + [f"o{i}"])) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    nodes = join.keep(join.signed(df, 4, 85, False), "test-nodes")
    rows = nodes.selectExpr("node", "node as label", "n", "doc_id", "0L as cluster")
    for sets in (2048, 64):
        monkeypatch.setattr(join, "BLOCK_SETS", sets)
        links = join.blockwise(df, rows, 4, 85)
        blocks = -(-300 // sets)
        assert links.count() < 300 * blocks
        label = join.components.label(links)
        assert label.count() == 300 and label.select("label").distinct().count() == 1
    assert got(df) == brute(docs)


def test_odd_rows(odd_docs, no_docs):
    rows = {r["doc_id"]: r for r in join.link(odd_docs).collect()}
    assert rows[1]["component_id"] == 1 and rows[1]["n_shingles"] == 0
    assert rows[4]["component_id"] == 4 and rows[None]["component_id"] is None
    assert join.link(odd_docs).count() == odd_docs.count()
    assert join.link(no_docs).count() == 0
    assert join.keep_first(odd_docs).columns == odd_docs.columns


def test_keep_first_keeps_one_of_each_group(spark):
    base = " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame([(3, base), (1, base + " x"), (2, "other text here now"), (4, None)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in join.keep_first(docs).collect()) == [1, 2, 4]
    clashing = docs.unionAll(docs).selectExpr("*", "1 as label", "2 as n", "3 as `a.b`", "4 as __id", "5 as component_id")
    out = join.keep_first(clashing)
    assert out.columns == clashing.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 2, 4]


def test_linked_sets_share_a_signature():
    """The guarantee itself, over random sets of every size at the edge of the threshold."""
    rng = np.random.default_rng(4)
    bands = join.Bands()
    for _ in range(400):
        n = int(rng.integers(1, 400))
        own = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        drop = int(rng.integers(0, n // 8 + 1))
        add = int(rng.integers(0, n // 8 + 1))
        other = np.concatenate((own[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64)))
        if not len(other) or 100 * (n - drop) < 85 * (n + add):
            continue
        own.sort()
        other.sort()
        a, _ = join.signatures(own, np.array([len(own)]), bands)
        b, _ = join.signatures(other, np.array([len(other)]), bands)
        assert len(np.intersect1d(a, b)), (n, drop, add)


def test_shingle_hashes_tell_words_apart():
    import pyarrow as pa

    texts = ["the cat sat on a mat", "The CAT sat\ton\x0ba  mat ", "", "a", " ", "é b c d e", "x"]
    for at, data, offsets in shingles.slices(pa.array(texts), 8):
        elements, counts = shingles.sets(data, offsets, 4)
        assert counts.tolist() == [len(shingle_set(t)) for t in texts[at : at + len(counts)]]
    (_, data, offsets), = shingles.slices(pa.array(texts))
    elements, counts = shingles.sets(data, offsets, 4)
    ids = shingles.set_ids(elements, counts)
    assert ids[0] == ids[1] and len(set(ids.tolist())) == 5


@pytest.mark.parametrize("percent", [80, 85])
def test_linked_sets_agree_as_often_as_both_need(percent):
    """And sets that have nothing in common don't meet by parts without elements."""
    rng = np.random.default_rng(9)
    bands = join.Bands(percent)
    made = lambda n: np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    for n in [*rng.integers(1, 60, 60).tolist(), *rng.integers(60, 3000, 90).tolist()]:
        own = made(n)
        drop = int(rng.integers(0, n * (100 - percent) // 100 + 1))
        other = np.sort(np.concatenate((own[drop:], made((n - drop) * 100 // percent - n))) if rng.random() < 0.5 and (n - drop) * 100 // percent > n else own[drop:])
        found = [join.needing(x, np.array([len(x)]), bands) for x in (own, other)]
        band = max(int(f[2][0]) for f in found)
        need = max(int(f[3 + (band - int(f[2][0]))][0]) for f in found)
        both = np.intersect1d(found[0][0], found[1][0])
        assert need >= 1 and (both & np.uint64(join.BAND) == band).sum() >= need, (n, len(other))
    for n in range(1000, 4000, 100):
        a, b = (join.signatures(made(n), np.array([n]), bands)[0] for _ in "ab")
        assert not len(np.intersect1d(a, b)), n


def test_signatures_of_one_set_only_are_not_sorted(spark, monkeypatch):
    """Of unrelated texts hardly a signature is shuffled with its set; none is lost that two sets share."""
    rng = random.Random(11)
    text = lambda: [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 400))]
    docs = [(i, " ".join(text())) for i in range(400)] + [(1000 + i, t) for i, t in enumerate(chain(30, 300, 3, rng))]
    docs += [(2000 + i, docs[i][1]) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    met, walk = [], join.neighbours
    monkeypatch.setattr(join, "neighbours", lambda rows, nodes: met.append([tuple(r) for r in rows.select("sig", "node").collect()]) or walk(rows, nodes))
    assert got(df) == brute(docs)
    every = {(s, r["node"]) for r in join.signed(df, 4, 85).collect() for s in r["sigs"]}
    often = {s for s, n in Counter(s for s, _ in every).items() if n > 1}
    assert {x for x in every if x[0] in often} <= set(met[0])
    assert len(met[0]) < len(every) / 2


@pytest.mark.parametrize("numbers", [[], [5], [0, 0, 7, 1 << 24, (1 << 24) + 1], [3, 3, (1 << 24) + 3, (1 << 32) - 1]])
def test_packed_numbers_are_read_back(numbers):
    assert join.unpacked(join.packed(np.array(numbers, np.uint32))).tolist() == numbers
