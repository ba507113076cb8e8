import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarack.operators import embedding, index, settings

ODD = [None, "", " ", "{", "[1]", "3", "{}"]


def over(base, override):
    """Recursive merge in plain Python."""
    out = dict(base)
    for k, v in override.items():
        out[k] = over(out[k], v) if isinstance(out.get(k), dict) and isinstance(v, dict) else v
    return out


def objects(text):
    try:
        got = json.loads(text or "{}")
    except ValueError:
        return {}
    return got if isinstance(got, dict) else {}


def test_merge_is_recursive_and_keeps_types(spark):
    deep = {"a": 1}
    for k in range(9):
        deep = {"n": deep, "k": k}
    base = {"agent": {"n": 10, "name": "x", "list": [1, 2]}, "rag": {"k1": 1.5, "on": True}, "gone": {"a": 1}, "deep": deep, "a.b": 1, "it's": 2}
    pairs = [
        (base, {"agent": {"n": 3, "list": [9]}, "gone": None, "rag": {"k1": "1.5", "new": {"z": 1}}, "a.b": {"c": 1}}),
        (base, {"agent": 5, "deep": {"n": {"n": {"n": {"k": "new"}}}}}),
        ({"a": 1}, {"a": {"b": 2}}),
    ]
    rows = [(json.dumps(a), json.dumps(b)) for a, b in pairs] + [(x, json.dumps(base)) for x in ODD] + [(json.dumps(base), x) for x in ODD] + [(None, None)]
    df = spark.createDataFrame(rows, "b string, o string").select("b", "o", settings.merged(F.col("b"), F.col("o")).alias("m"))
    for r in df.collect():
        assert json.loads(r["m"]) == over(objects(r["b"]), objects(r["o"])), r


def test_lookup_by_path_and_type(spark):
    text = json.dumps({"agent": {"n": 10, "name": "x", "off": None, "list": [1]}, "it's": {"a\\b": 2}})
    df = spark.createDataFrame([(text,)], "c string")
    at = lambda path, kind="string", default=None: df.select(settings.lookup(F.col("c"), path, kind, default)).first()[0]
    assert at("agent.n", "int", 3) == 10 and at("agent.name") == "x" and at("it's.a\\b", "int") == 2
    assert at("agent.off", "int", 7) == 7 == at("agent.none", "int", 7) == at("agent.n.more", "int", 7) == at("agent.name", "int", 7) == at("agent.list.0", "int", 7)
    assert at("none") is None
    odd = spark.createDataFrame([(x,) for x in ODD], "c string").select(settings.lookup(F.col("c"), "a.b", "int", 1))
    assert {r[0] for r in odd.collect()} == {1}


def test_a_model_is_loaded_once_a_worker_and_gets_batches(spark, tmp_path):
    told = str(tmp_path / "told")

    def load():
        import os

        model = embedding.letters()

        def seen(texts):
            with open(told, "a") as out:
                out.write(f"{os.getpid()} {len(texts)}\n")
            return model(texts)

        with open(told, "a") as out:
            out.write(f"{os.getpid()} load\n")
        return seen

    chunks = spark.range(1000).select(F.concat(F.lit("a" * 3 + "z"), F.col("id").cast("string")).alias("document")).coalesce(2)
    got = embedding.embedded(chunks.union(spark.createDataFrame([(None,)], "document string")), load, 64).collect()
    want = np.zeros(26)
    want[0], want[25] = 3, 1
    assert all(r["embedding"] == (want.tolist() if r["document"] else [0.0] * 26) for r in got) and len(got) == 1001
    lines = [x.split() for x in open(told)]
    loads = [p for p, what in lines if what == "load"]
    assert len(loads) == len(set(loads))
    sizes = [int(what) for _, what in lines if what != "load"]
    assert sum(sizes) == 1001 and max(sizes) == 64 and sum(s < embedding.MIN_BATCH for s in sizes) <= 3
    with pytest.raises(ValueError):
        embedding.encoder(load, 10)


def test_only_fresh_chunks_meet_the_model(spark):
    files = spark.createDataFrame([("a.md", 1.0, "aa"), ("b.md", 1.0, "b")], "file string, mtime double, content string")
    state = spark.createDataFrame([("b.md", 1.0)], "file string, mtime double")
    old = spark.createDataFrame([("b.md:1-1", "b.md", 1, 1, "old", [9.0])], "uid string, file string, start_line int, end_line int, document string, embedding array<float>")
    got = index.build(files, state, old, lambda fresh: embedding.embedded(fresh, embedding.letters)).index
    assert {r["uid"]: r["embedding"][0] for r in got.collect()} == {"a.md:1-1": 2.0, "b.md:1-1": 9.0}
