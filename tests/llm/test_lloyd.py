import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from tamarack.llm import lloyd
from tamarack.llm.common import table


def brute(rows, rounds=3):
    """Plain Lloyd with whole numbers of Python over (vec_id, components)."""
    x = [(i, [math.floor(64 * float(c)) for c in v]) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v)]
    drawn = sorted(x, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:16]
    at = [v for _, v in drawn]
    for k in range(rounds + 1):
        own = [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(at)) for _, v in x]
        if k < rounds:
            for n in range(len(at)):
                mine = [v for (_, v), (_, o) in zip(x, own) if o == n]
                if mine:
                    at[n] = [sum(c) // len(mine) for c in zip(*mine)]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    sums = [sum(d for d, o in own if o == n) for n in range(len(at))]
    return sorted(((i, o, d, sums[o], sum(sums), digest[o]) for (i, _), (d, o) in zip(x, own)), key=repr)


def held(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_equals_plain_lloyd(spark, sf):
    vectors = table(spark, sf, "embeddings")
    assert held(lloyd.fit(vectors)) == brute([(r["vec_id"], r["embedding"]) for r in vectors.collect()])


def test_odd_vectors(spark):
    draw = random.Random(3)
    v = lambda: [draw.choice((-0.5, 0.0, 0.25)) for _ in range(64)]
    same = v()
    rows = [(i, v()) for i in range(60)] + [(100 + i, same) for i in range(30)] + [(7, same), (7, same), (None, v())]
    rows += [(200, None), (201, []), (202, v()[:63]), (203, [*v()[:63], None]), (204, [*v()[:63], float("nan")]), (205, [*v()[:63], float("inf")]), (206, v() + [0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("owner", F.lit("mine")).withColumn("v", F.lit(1))
    got = held(lloyd.fit(vectors))
    assert got == brute(rows) and {r[0] for r in got} == {*range(60), *range(100, 130), 7, None}


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    few = [(1, [0.1] * 64), (2, [0.1] * 64), (3, [-0.1] * 64)]
    assert held(lloyd.fit(spark.createDataFrame(few, schema))) == brute(few)
    assert lloyd.fit(spark.createDataFrame([], schema)).count() == 0


def test_only_changed_centroids_are_compared(monkeypatch):
    draw = np.random.default_rng(1)
    x, old = draw.integers(-9, 9, (500, 8)), draw.integers(-9, 9, (6, 8))
    owner, distance = lloyd.nearest(x, old)
    new = old.copy()
    new[2], new[5] = new[2] + 1, new[5] - 1
    changed = (new != old).any(1)
    seen = []
    monkeypatch.setattr(lloyd, "nearest", lambda a, c, f=lloyd.nearest: (seen.append((len(a), len(c))), f(a, c))[1])
    got = lloyd.compared(x, owner, distance, new, changed)
    loose = int(np.isin(owner, (2, 5)).sum())
    assert seen == [(loose, 6), (500 - loose, 2)]
    far = ((x[:, None] - new[None]) ** 2).sum(2)
    assert (got[0] == far.argmin(1)).all() and (got[1] == far.min(1)).all()


def test_transfers_are_signed_and_read_moved_vectors_only(spark):
    rows = [([1, 2], 0, -1, True), ([3, 4], 1, 0, True), ([9, 9], 1, 1, False)]
    df = spark.createDataFrame(rows, "v array<int>, owner int, was int, moved boolean")
    assert lloyd.transferred(df, 2, 2).tolist() == [[-2, -2, 0], [3, 4, 1]]


def test_large_components_stay_exact():
    x = np.array([[1 << 26, -(1 << 26)], [(1 << 26) + 1, 0]], np.int64)
    owner, distance = lloyd.nearest(x, np.array([[0, 0], [1 << 26, 1]], np.int64))
    assert owner.tolist() == [1, 1] and distance.tolist() == [((1 << 26) + 1) ** 2, 2]
