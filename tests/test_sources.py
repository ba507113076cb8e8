import json
import os
import pickle

import pytest

from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from tamarack.sources import files, folder, pages


def test_scan_skips_folders_and_drops_bad_bytes(spark, tmp_path):
    for name, data in {"a.py": b"x\xff\xfey", "sub/b.md": "é".encode(), ".git/c.py": b"no", "d.bin": b"no", "sub/E.PY": b"no", "f.cpp": b"int"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rows = {r["file"]: r["content"] for r in files.scan(spark, str(tmp_path)).collect()}
    assert rows == {"a.py": "xy", "sub/b.md": "é", "f.cpp": "int"}
    assert {r["file"] for r in files.scan(spark, str(tmp_path), files.SEARCHED).collect()} == {"a.py", "sub/b.md"}
    assert [r["entry"] for r in files.listing(spark, str(tmp_path)).collect()] == [".git/", "a.py", "d.bin", "f.cpp", "sub/"]


def test_listing_has_hidden_and_empty_entries(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    for name in ("__init__.py", ".hidden", "b[1].txt"):
        (tmp_path / name).write_text("x")
    assert [r["entry"] for r in files.listing(spark, str(tmp_path)).collect()] == [".hidden", "__init__.py", "b[1].txt", "empty/"]
    assert files.listing(spark, str(tmp_path / "empty")).count() == 0
    for read in (files.listing, files.scan):
        with pytest.raises(FileNotFoundError):
            read(spark, str(tmp_path / "none"))


def test_scan_opens_wanted_files_only(spark, tmp_path):
    """Names that Spark's readers hide are read; what is not wanted couldn't be."""
    for name in ("p/__init__.py", "p/_own.py", "p/deep/er/x[1] {y}.md", "node_modules/a.js", ".tamarack/state.json", "big.bin"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    for name in ("node_modules/a.js", ".tamarack/state.json", "big.bin"):
        (tmp_path / name).unlink()
        (tmp_path / name).symlink_to(tmp_path / "loop" / name)  # can be listed, not opened
    rows = {r["file"]: r["content"] for r in files.scan(spark, f"file://{tmp_path}").collect()}
    assert rows == {x: x for x in ("p/__init__.py", "p/_own.py", "p/deep/er/x[1] {y}.md")}


def test_a_wide_tree_is_walked_in_many_tasks(spark, tmp_path, monkeypatch):
    want = set()
    for i in range(70):
        for j in range(2):
            (tmp_path / f"d{i}" / f"e{j}").mkdir(parents=True)
            (tmp_path / f"d{i}" / f"e{j}" / "f.py").write_text("x")
            want.add(f"d{i}/e{j}/f.py")
    got = files.listed(spark, str(tmp_path))
    assert {r["file"] for r in got.collect()} == want and got.rdd.getNumPartitions() > 20


def test_rows_are_written_as_files_or_not_at_all(spark, tmp_path):
    root = tmp_path / "out"
    rows = spark.createDataFrame([("a.txt", "é"), ("sub/b.txt", ""), ("sub/c.txt", None)], "file string, content string")
    files.write_files(rows, str(root))
    assert {str(p.relative_to(root)): p.read_text() for p in root.rglob("*") if p.is_file()} == {"a.txt": "é", "sub/b.txt": "", "sub/c.txt": ""}
    with pytest.raises(Exception, match="not a file under the root"):
        files.write_files(spark.createDataFrame([("new.txt", "x"), ("../out.txt", "x")], "file string, content string").coalesce(1), str(root))
    assert sorted(p.name for p in root.rglob("*") if p.is_file()) == ["a.txt", "b.txt", "c.txt"]


def test_files_are_written_from_small_batches(spark, tmp_path):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    files.write_files(spark.createDataFrame([("a.txt", "x")], "file string, content string"), str(tmp_path))
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == f"{8 << 20}b"


def test_state_and_eval_files(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"a.py": 1.5, "b.py": 2}))
    (tmp_path / "bad.json").write_text("{")
    assert {tuple(r) for r in files.read_state(spark, str(tmp_path / "s.json")).collect()} == {("a.py", 1.5), ("b.py", 2.0)}
    assert files.read_state(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "e.json").write_text(json.dumps([{"query": "q", "relevant": ["a"]}]))
    assert files.read_eval(spark, str(tmp_path / "e.json")).first()["relevant"] == ["a"]
    files.write_state(spark.createDataFrame([("a", 1.0)], "file string, mtime double"), str(tmp_path / "out"))
    assert [tuple(r) for r in files.read_state(spark, str(tmp_path / "out")).collect()] == [("a", 1.0)]


def test_index_read_fills_what_is_missing(spark, tmp_path):
    spark.createDataFrame([("1", None, None)], "uid string, file string, document string").write.parquet(str(tmp_path / "i"))
    assert tuple(files.read_index(spark, str(tmp_path / "i")).first()) == ("1", "", "")


def test_page_text(spark):
    html = "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><header>h</header><nav>n</nav><p>A &amp; <b>B</b> c</p><aside>x<p>y</p></aside><footer>f</footer><p> </p>end</body></html>"
    df = spark.createDataFrame([(1, html), (2, None), (3, "<p>" + "x" * 5000)], "page_id long, html string")
    rows = {r["page_id"]: r for r in pages.page_text(df).collect()}
    assert rows[1]["text"] == "T\nA &\nB\nc\nend"
    assert rows[2]["text"] == pages.EMPTY
    assert rows[3]["text"] == "x" * 4000 + "\n...[cut, 5000 characters in all]" and rows[3]["n_chars"] == 5000


def test_page_text_goes_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(pages, "BATCH", 100)
    df = spark.createDataFrame([(i, f"<p>{'x' * i}</p>") for i in range(200)], "page_id int, html string")
    assert sorted(tuple(r) for r in pages.page_text(df).collect()) == [(i, "x" * i or pages.EMPTY, i) for i in range(200)]
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == f"{8 << 20}b"


def test_text_sink(spark, tmp_path):
    files.write_text(spark.createDataFrame([("a 1",)], "page string"), str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m")).select(F.first("value")).first()[0] == "a 1"


def test_a_written_state_is_read_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "STATE_FILES", 3)
    rows = [(f"d/{i}.py", i + 0.5) for i in range(10)]
    files.write_state(spark.createDataFrame(rows, "file string, mtime double"), str(tmp_path / "state"))
    assert sorted(tuple(r) for r in files.read_state(spark, str(tmp_path / "state")).collect()) == sorted(rows)


def test_the_driver_holds_no_names_of_files(tmp_path, monkeypatch):
    """Whatever the number of files: neither what a walk's plan nor what a task's end tells grows with it."""
    monkeypatch.setattr(folder, "SHARE", 100, raising=False)
    schema = StructType().add("file", "string").add("content", "string")
    plans, told = [], []
    for n in (200, 3000):
        root = str(tmp_path / str(n))
        writer = folder.FolderWriter({"path": root}, schema, False)
        message = writer.write((f"s{i % 3}/f{i}.txt", f"{i}") for i in range(n))
        told.append(len(pickle.dumps(message)))
        writer.commit([message, None])
        reader = folder.FolderReader({"path": root})
        parts = reader.partitions()
        plans.append(max(len(pickle.dumps(p)) for p in parts))
        rows = [r for p in parts for r in reader.read(p)]
        assert sorted((r[0], r[2], r[4]) for r in rows) == sorted([(f"s{i % 3}/f{i}.txt", False, len(str(i))) for i in range(n)] + [(f"s{i}", True, None) for i in range(3)])
        assert all(r[1] == f"{root}/{r[0]}" and r[3] == os.stat(r[1]).st_mtime_ns / 1e9 for r in rows)
    assert max(told) < 500 and max(plans) < 1000


def test_a_folder_of_many_folders_is_walked_whole(tmp_path, monkeypatch):
    monkeypatch.setattr(folder, "WIDE", 20, raising=False)
    want = {f"a/{i}" for i in range(30)} | {f"a/{i}/b/x.py" for i in range(30)} | {f"a/{i}/b" for i in range(30)} | {"a", "top.md"}
    for name in want:
        if name.endswith((".py", ".md")):
            (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / name).write_text("x")
    for deep, names in (("true", want), ("false", {"a", "top.md"})):
        reader = folder.FolderReader({"path": f"file://{tmp_path}", "recursive": deep})
        assert sorted(r[0] for p in reader.partitions() for r in reader.read(p)) == sorted(names)


def test_a_name_written_twice_by_a_task_holds_the_last(tmp_path, monkeypatch):
    monkeypatch.setattr(folder, "SHARE", 2, raising=False)
    writer = folder.FolderWriter({"path": str(tmp_path)}, StructType().add("file", "string").add("content", "string"), False)
    writer.commit([writer.write(iter([("a", "1"), ("b", "2"), ("c", "3"), ("a", "4"), ("a", "5")]))])
    assert {p.name: p.read_text() for p in tmp_path.iterdir()} == {"a": "5", "b": "2", "c": "3"}
