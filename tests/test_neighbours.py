import numpy as np
import pytest

from tamarack.operators import neighbours, retrieval
from tamarack.plans import registry


def brute(vectors, queries, limit):
    out = set()
    for q, a in queries:
        if a is None or None in a:
            continue
        near = [(round(-sum((x - y) ** 2 for x, y in zip(a, b)), 6) + 0.0, u) for u, b in vectors if b is not None and len(b) == len(a) and None not in b]
        out |= {(q, u, s, k + 1) for k, (s, u) in enumerate(sorted(near, key=lambda x: (-x[0], x[1]))[:limit])}
    return out


def tables(spark, vectors, queries):
    return spark.createDataFrame(vectors, "uid string, embedding array<double>"), spark.createDataFrame(queries, "query_id long, embedding array<double>")


ODD = [("a", [0.0, 1.0]), ("b", [0.0, 1.0]), ("c", [2.0, 2.0]), ("d", None), ("e", [1.0]), ("f", [None, 1.0]), ("g", [])]
ASKED = [(1, [0.0, 1.0]), (None, [2.0, 1.0]), (3, None), (4, [1.0]), (5, [None, 0.0]), (6, [])]


@pytest.mark.parametrize("most", [4096, 1])
def test_odd_vectors_and_queries(spark, monkeypatch, most):
    """Broadcast or joined block by block, the same."""
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", most)
    vectors, queries = tables(spark, ODD, ASKED)
    got = {tuple(r) for r in retrieval.vector_topk(vectors, queries, 2).collect() if r["query_id"] != 6}
    assert got == brute(ODD, [q for q in ASKED if q[0] != 6], 2)
    assert retrieval.vector_topk(vectors.limit(0), queries).count() == 0 == retrieval.vector_topk(vectors, queries.limit(0)).count()


def test_a_hot_cell_is_searched_in_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ROWS", 40)
    monkeypatch.setattr(neighbours, "ASKED", 7)
    draw = np.random.default_rng(4)
    rows = [(f"u{i}", draw.integers(-3, 4, 3).astype(float).tolist()) for i in range(300)]
    asked = [(i, draw.integers(-3, 4, 3).astype(float).tolist()) for i in range(30)]
    vectors, queries = tables(spark, rows, asked)
    want = brute(rows, asked, 5)
    cells = neighbours.Cells(np.array([[0.0, 0.0, 0.0]]), 1)
    assert {tuple(r) for r in neighbours.search(neighbours.indexed(vectors, cells), queries, cells, 5).collect()} == want
    assert {tuple(r) for r in neighbours.ranked(neighbours.exact(vectors, queries, 5), 5, "vector_rank").collect()} == want


def test_cells_hold_every_vector_once_and_a_written_index_answers(spark, tmp_path):
    vectors, queries = tables(spark, ODD, ASKED)
    cells = neighbours.fit(vectors, cells=2)
    index = neighbours.indexed(vectors, cells)
    assert sorted(r["uid"] for r in index.collect()) == ["a", "b", "c"]
    index.write.partitionBy("cell").parquet(str(tmp_path / "i"))
    got = neighbours.search(spark.read.parquet(str(tmp_path / "i")), queries, neighbours.Cells(cells.centroids, 2), 9)
    assert {tuple(r) for r in got.collect()} == brute([v for v in ODD if v[0] in "abc"], ASKED[:2], 9)
    assert neighbours.fit(vectors.limit(0)).probes == 0 and neighbours.search(index, queries, neighbours.fit(vectors.limit(0))).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_of_the_registered_query(spark, sf):
    key = lambda df: {(r["query_id"], r["uid"]) for r in df.collect()}
    got, want = key(registry.queries()["vector_cells"](spark, sf)), key(registry.queries()["vector_topk"](spark, sf))
    assert len(got & want) >= 0.9 * len(want)


def test_clustered_vectors_need_few_cells(spark):
    draw = np.random.default_rng(2)
    at = draw.normal(size=(20, 16)) * 10
    rows = [(str(i), (at[i % 20] + draw.normal(size=16)).tolist()) for i in range(1500)]
    vectors, _ = tables(spark, rows, ASKED)
    cells = neighbours.fit(vectors)
    assert len(cells.centroids) == 39 and cells.probes <= 6


def test_vectors_are_shuffled_as_often_whatever_their_number():
    """Each vector goes once to every block, each query once to every shard; a task's share is bounded."""
    copies = []
    for n in (10_000, 100_000, 400_000):
        ((_, shards, blocks),) = neighbours.cuts({64: n}, {64: n}, 12)
        assert -(-n // shards) <= neighbours.ROWS and -(-n // blocks) <= neighbours.ASKED and shards * blocks >= 12
        copies.append(shards + blocks)
    assert max(copies) <= copies[0]
    ((_, shards, blocks),) = neighbours.cuts({64: 1_000_000}, {64: 1_000_000}, 12)
    assert shards + blocks <= 32


def test_distances_taken_a_few_at_a_time_and_single_precision(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PRODUCTS", 50)
    draw = np.random.default_rng(4)
    rows = [(f"u{i}", draw.integers(-3, 4, 3).astype(float).tolist()) for i in range(90)]
    asked = [(i, draw.integers(-3, 4, 3).astype(float).tolist()) for i in range(30)]
    vectors = spark.createDataFrame(rows, "uid string, embedding array<float>")
    queries = spark.createDataFrame(asked, "query_id long, embedding array<float>")
    met = neighbours.exact(vectors, queries, 5)
    assert {tuple(r) for r in neighbours.ranked(met, 5, "vector_rank").collect()} == brute(rows, asked, 5)
    plan = met._jdf.queryExecution().analyzed().toString()
    assert "array<float>" in plan and "array<double>" not in plan
