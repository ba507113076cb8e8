from pyspark.sql import functions as F
from tamarack.operators import index
from tamarack.sources import files


def test_diff_refresh_and_summary(spark):
    disk = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 3.0)], "file string, mtime double")
    state = spark.createDataFrame([("b", 2.0), ("c", 3.0), ("d", 1.0)], "file string, mtime double")
    changes = index.diff(disk, state)
    assert {tuple(r) for r in changes.collect()} == {("a", "new"), ("b", "changed"), ("c", "unchanged"), ("d", "deleted")}
    old = spark.createDataFrame([("b:1-1", "b", "old"), ("b:2-2", "b", "old"), ("c:1-1", "c", "old"), ("d:1-1", "d", "old")], "uid string, file string, document string")
    fresh = spark.createDataFrame([("a:1-1", "a", "new"), ("b:1-1", "b", "new")], "uid string, file string, document string")
    done = index.refresh(old, changes, fresh)
    assert {tuple(r) for r in done.collect()} == {("a:1-1", "a", "new"), ("b:1-1", "b", "new"), ("c:1-1", "c", "old")}
    assert tuple(index.summary(done, changes).first()) == (3, 3, 1)
    assert {r["file"] for r in index.next_state(disk).collect()} == {"a", "b", "c"}


def test_upsert_replaces_by_key(spark):
    a = spark.createDataFrame([("1", "x"), ("2", "y")], "uid string, file string")
    b = spark.createDataFrame([("2", "z")], "uid string, file string")
    assert {tuple(r) for r in index.upsert(a, b).collect()} == {("1", "x"), ("2", "z")}


def test_build_over_two_snapshots_and_a_saved_state(spark, tmp_path):
    schema = "file string, mtime double, content string"
    module = "def first(a):\n    return a\n\nclass Second:\n    pass\n"
    one = spark.createDataFrame([("a.py", 1.0, module), ("b.md", 1.0, "text"), ("c.md", 1.0, None), ("d.md", 1.0, "gone")], schema)
    empty = spark.createDataFrame([], "file string, mtime double")
    seen = lambda df: df.withColumn("size", F.length("document"))
    first = index.build(one, empty, None, seen)
    assert {r["uid"] for r in first.index.collect()} == {"a.py:1-2", "a.py:4-5", "b.md:1-1", "d.md:1-1"}
    assert first.summary.first().asDict() == {"files": 4, "chunks": 4, "removed": 0, "up_to_date": False}
    files.write_state(first.state, str(tmp_path / "state"))
    first.index.write.parquet(str(tmp_path / "index"))
    state, held = files.read_state(spark, str(tmp_path / "state")), spark.read.parquet(str(tmp_path / "index"))
    assert index.build(one, state, held, seen).summary.first()["up_to_date"]
    two = spark.createDataFrame([("a.py", 2.0, "x\n" + module), ("b.md", 1.0, "unread"), ("c.md", 1.0, None), ("e.md", 1.0, "new")], schema)
    second = index.build(two, state, held, seen)
    assert {(r["uid"], r["size"]) for r in second.index.collect()} == {("a.py:2-3", 26), ("a.py:5-6", 22), ("b.md:1-1", 4), ("e.md:1-1", 3)}
    assert second.summary.first().asDict() == {"files": 2, "chunks": 3, "removed": 1, "up_to_date": False}
    assert {r["document"] for r in index.build(two, state, held, seen, force=True).index.where("file = 'b.md'").collect()} == {"unread"}
    assert index.build(one.limit(0), state, held, seen).index.count() == 0


def test_a_folder_is_built_by_reading_changed_files_only(spark, tmp_path, monkeypatch):
    root = tmp_path / "src"
    root.mkdir()
    for name, text in {"a.py": "def first(a):\n    return a\n", "b.md": "one", "c.md": "two"}.items():
        (root / name).write_text(text)
    empty = spark.createDataFrame([], "file string, mtime double")
    first = index.build_folder(spark, str(root), empty)
    first.index.write.parquet(str(tmp_path / "index"))
    files.write_state(first.state, str(tmp_path / "state"))
    state, held = files.read_state(spark, str(tmp_path / "state")), spark.read.parquet(str(tmp_path / "index"))
    assert {r["uid"] for r in held.collect()} == {"a.py:1-2", "b.md:1-1", "c.md:1-1"}
    (root / "b.md").write_text("new")
    (root / "c.md").unlink()
    (root / "d.md").write_text("four")
    read = []
    monkeypatch.setattr(index, "contents", lambda chosen: (read.append(sorted(r["file"] for r in chosen.collect())), files.contents(chosen))[1])
    second = index.build_folder(spark, str(root), state, held)
    assert {(r["uid"], r["document"]) for r in second.index.collect() if r["file"] != "a.py"} == {("b.md:1-1", "new"), ("d.md:1-1", "four")}
    assert read == [["b.md", "d.md"]]
    assert second.summary.first().asDict() == {"files": 2, "chunks": 2, "removed": 1, "up_to_date": False}


def test_repeated_and_nameless_files(spark):
    schema = "file string, mtime double, content string"
    empty = spark.createDataFrame([], "file string, mtime double")
    rows = [("a.md", 1.0, "old"), ("a.md", 2.0, "new"), ("a.md", 2.0, "mid"), (None, 3.0, "none"), ("b.md", 1.0, None)]
    got = index.build(spark.createDataFrame(rows, schema), empty)
    assert [(r["uid"], r["document"]) for r in got.index.collect()] == [("a.md:1-1", "new")]
    assert sorted(tuple(r) for r in got.state.collect()) == [("a.md", 2.0), ("b.md", 1.0)]
