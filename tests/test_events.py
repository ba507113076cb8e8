import random
from collections import deque

from pyspark.sql import functions as F

from tamarack.operators import events
from tamarack.plans import registry

SCHEMA = "arrival long, task_id string, seq long, type string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_ring_cursor_and_clear(spark):
    df = frame(spark, [(i, f"t{i % 2}", i, "x") for i in range(40)])
    assert events.ring(df, 5).count() == 10
    cursors = spark.createDataFrame([("t0", 30), ("t1", 100), ("t9", 7)], "task_id string, cursor long")
    assert sorted(r["seq"] for r in events.since(df, cursors).collect()) == [32, 34, 36, 38]
    assert {tuple(r) for r in events.next_cursors(df, cursors).collect()} == {("t0", 38), ("t1", 100), ("t9", 7)}
    assert events.clear(df, cursors.where("task_id = 't0'")).where("task_id = 't0'").count() == 0


def replay(rows, per_task, total):
    """All rows one after the other, the whole state looked at each time."""
    state, order = {}, []
    for r in rows:
        if r[1] not in state:
            state[r[1]] = deque()
            order.append(r[1])
        state[r[1]].append(r)
        if len(state[r[1]]) > per_task:
            state[r[1]].popleft()
        while sum(map(len, state.values())) > total:
            state[order[0]].popleft()
            if not state[order[0]]:
                del state[order.pop(0)]
    return sorted(x for q in state.values() for x in q)


def test_eviction_is_a_replay(spark):
    rng = random.Random(5)
    rows = [(i, f"t{rng.randrange(5)}", i, "x") for i in range(400)]
    got = sorted(tuple(r) for r in events.evict(frame(spark, rows), 12, 30, 150).collect())
    assert got == replay(rows, 12, 30)


def test_eviction_by_bursts_nulls_and_clashing_names(spark):
    rng, rows = random.Random(8), []
    while len(rows) < 300:
        task = rng.choice(["a", "b", None, "c", "d", "e"])
        rows += [(len(rows) + k, task, k, "x") for k in range(rng.randrange(1, 25))]
    df = frame(spark, rows).withColumn("_n", F.lit(1)).withColumn("_back", F.lit("mine")).withColumn("a.b", F.lit(2))
    got = events.evict(df, 15, 40, 70)
    assert got.columns == df.columns
    plain = [(i, t or "", s, k) for i, t, s, k in rows]
    assert sorted((r["arrival"], r["task_id"] or "", r["seq"], r["type"]) for r in got.collect()) == replay(plain, 15, 40)
    assert events.evict(df.limit(0)).count() == 0
    ringed = events.ring(df, 3)
    assert ringed.columns == df.columns and {r["_back"] for r in ringed.collect()} == {"mine"}


def test_a_range_is_folded_from_numbers_alone(spark):
    """What a fold starts from and gives is bounded by ``total``, whatever came before."""
    import pandas as pd

    runs = pd.DataFrame({"place": range(500), "task_id": [f"t{i}" for i in range(500)], "n": [3] * 500})
    out = pd.concat(events._folded([("old", 9)], 5, 20)(iter([runs])))
    assert out["n"].sum() == 20 and len(out) <= 20


def test_status_rules(spark):
    life = {
        "a": ["created"], "b": ["created", "started", "tool_call"], "c": ["created", "started", "completed"], "d": ["created", "started", "failed", "completed"],
        "e": ["created", "cancelled"], "f": ["created", "started", "cancelled", "completed"],
    }
    rows = [(i, t, i, k) for t, ks in life.items() for i, k in enumerate(ks)]
    got = {r["task_id"]: r["status"] for r in events.statuses(frame(spark, rows)).collect()}
    assert got == {"a": "pending", "b": "running", "c": "completed", "d": "failed", "e": "cancelled", "f": "completed"}
    tasks = events.statuses(frame(spark, rows))
    assert tuple(events.metrics(tasks).first()) == (6, 2, 1)
    assert "tasks_total 6\n" in events.exposition(events.metrics(tasks)).first()["page"]
    assert tuple(events.gauges(tasks).first()) == (1, 20, 20)


def test_the_registered_eviction_is_a_replay_of_the_whole_table(spark):
    where = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in registry.queries()["events_evict"](spark, where).select("seq", "task_id", "type").collect())
    rows = spark.read.parquet(where + "/events.parquet").orderBy("event_id").collect()
    want = replay([(r["event_id"], r["user_id"], r["event_id"], r["event_type"]) for r in rows], 50, 2000)
    assert got == sorted((r[2], r[1], r[3]) for r in want)
