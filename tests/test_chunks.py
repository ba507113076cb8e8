import pytest
from tamarack.operators import chunks
from pyspark.sql import functions as F

SOURCE = "import os\n\n@deco\ndef first(a):\n    return a\n\nclass Second:\n    def inner(self):\n        pass\n\nasync def third():\n    pass\nx = 1\n"


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "file string, content string")


def test_windows(spark):
    text = "\n".join(f"l{i}" for i in range(60)) + "\n"
    rows = chunks.fixed(files(spark, ("a", text), ("b", " \n\t"), ("c", None))).orderBy("start_line").collect()
    assert [(r["start_line"], r["end_line"]) for r in rows] == [(1, 30), (31, 60)]
    assert rows[0]["content"].split("\n")[-1] == "l29"


def test_python_definitions_and_fallbacks(spark):
    got = chunks.chunk(files(spark, ("a.py", SOURCE), ("bad.py", "def x(:\n"), ("none.py", "x = 1\n"), ("t.md", "def f():\n    pass\n")))
    rows = {(r["file"], r["start_line"], r["end_line"]) for r in got.collect()}
    assert rows == {("a.py", 4, 5), ("a.py", 7, 9), ("a.py", 11, 12), ("bad.py", 1, 2), ("none.py", 1, 2), ("t.md", 1, 3)}
    assert {r["u"] for r in got.where("file = 't.md'").select(chunks.uid().alias("u")).collect()} == {"t.md:1-3"}


def test_line_slice_numbers_and_clamps(spark):
    rows = chunks.line_slice(files(spark, ("a", "x\ny\nz")), 1, 99).orderBy("line_no").collect()
    assert [r["line"] for r in rows] == ["   2 | y", "   3 | z"]


def test_regex_search_orders_limits_and_strips(spark):
    got = chunks.regex_search(files(spark, ("b", "  Foo  \nbar\nfoo"), ("a", "xfoo" + "y" * 200)), "(?i)foo", 2).collect()
    assert [(r["file"], r["line_no"], len(r["line"])) for r in got] == [("a", 1, 120), ("b", 1, 3)]
    assert chunks.regex_search(files(spark, ("a", "b")), "zzz").select(F.count("*")).first()[0] == 0


def test_regex_search_holds_each_line_against_the_pattern(spark):
    got = chunks.regex_search(files(spark, ("a", "x = 1\ndef foo():\n    pass\n")), "^def .*:$").collect()
    assert [(r["file"], r["line_no"], r["line"]) for r in got] == [("a", 2, "def foo():")]
    with pytest.raises(ValueError, match="invalid pattern"):
        chunks.regex_search(files(spark, ("a", "b")), "(")
