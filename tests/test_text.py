from pyspark.sql import functions as F
from tamarack.functions import text

CASES = {
    "getUserName HTTPServer x2Y": ["get", "user", "name", "http", "server", "x2", "y"],
    "检索代码": ["检索代码", "检", "索", "代", "码", "检索", "索代", "代码"],
    "码": ["码"],
    "代码": ["代码", "代", "码"],
    "Étion_a b": ["tion", "a", "b"],
    "": [],
    None: [],
    "snake_case-kebab 42": ["snake", "case", "kebab", "42"],
    "aB": ["a", "b"],
}


def test_tokens(spark):
    df = spark.createDataFrame([(s,) for s in CASES], "s string")
    for r in df.select("s", text.tokenize(F.col("s")).alias("t")).collect():
        assert r["t"] == CASES[r["s"]], r["s"]


def test_lines_snippet_and_estimate(spark):
    df = spark.createDataFrame([("a\nb\n",), ("",), ("x" * 400,)], "s string")
    rows = df.select(F.size(text.lines(F.col("s"))).alias("n"), F.length(text.snippet(F.col("s"))).alias("m"), text.token_estimate(F.length("s")).alias("e")).collect()
    assert [tuple(r) for r in rows] == [(3, 4, 1), (1, 0, 0), (1, 150, int(400 / 3 * 1.2))]


def test_white_space_is_unicode(spark):
    df = spark.createDataFrame([(" 　\t",), (" x",)], "s string")
    assert [r[0] for r in df.select(text.has_text(F.col("s"))).collect()] == [False, True]
