from pyspark.sql import functions as F
from tamarack.operators import protocol


def test_rpc_kinds(spark):
    cases = {
        '{"id":1,"result":null}': "response", '{"id":1,"error":{}}': "error", '{"id":"a","method":"m"}': "request",
        '{"id":null,"method":"m"}': "notification", '{"method":"m"}': "notification", '{"result":1,"error":2}': "response",
    }
    df = spark.createDataFrame([(k,) for k in cases], "m string")
    assert {r["m"]: r["k"] for r in df.select("m", protocol.rpc_kind(F.col("m")).alias("k")).collect()} == cases


def test_denylist(spark):
    cases = {"RM  -rf /": True, "git log --format=x": True, "ls -la": False, "chmod 777 /etc": True, "r m - r f": True}
    df = spark.createDataFrame([(k,) for k in cases], "c string")
    assert {r["c"]: r["d"] for r in df.select("c", protocol.denied(F.col("c")).alias("d")).collect()} == cases


def test_arguments_names_and_contents(spark):
    df = spark.range(1).select(
        protocol.clean_arguments(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit(None).cast("string"), F.lit("workdir"), F.lit("w"))).alias("m"),
        protocol.tool_name(F.lit("s"), F.lit("t")).alias("n"),
        protocol.content_text(F.array(F.struct(F.lit("text").alias("type"), F.lit("x").alias("text")), F.struct(F.lit("image").alias("type"), F.lit("y").alias("text")), F.struct(F.lit("text").alias("type"), F.lit("z").alias("text")))).alias("c"),
    )
    assert tuple(df.first()) == ({"a": "1"}, "mcp_s_t", "x\nz")


def test_catalog_and_settings(spark):
    rows = [(1, "a", "sk-xxx"), (2, "b", " "), (3, "c", "key"), (4, "d", "key")]
    catalog = spark.createDataFrame(rows, "ordinal int, name string, key string")
    assert protocol.first_available(catalog).first()["name"] == "c"
    assert protocol.first_available(catalog.where("ordinal < 3")).first()["name"] == "none"
    config = spark.createDataFrame([('{"a": {"b": 1, "c": null}}',), ("not json",), (None,)], "c string")
    rows = config.select(*[protocol.setting(F.col("c"), x, "9").alias(x[-1]) for x in ("a.b", "a.c", "a.b.x", "d")]).collect()
    assert [tuple(r) for r in rows] == [("1", "9", "9", "9"), ("9", "9", "9", "9"), ("9", "9", "9", "9")]
