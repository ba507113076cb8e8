import __spark_entry__ as entry


def test_regex_search_asks_for_every_line_that_names_a_license(spark, tmp_path):
    rows = [(1, "no word\nthe license of x", "s"), (2, "License", "s"), (3, "a Licensee, mid-line\nlicence", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = entry.queries()["regex_search"](spark, str(tmp_path)).collect()
    assert [(r["file"], r["line_no"]) for r in got] == [("s/1.txt", 2), ("s/2.txt", 1), ("s/3.txt", 1)]
    assert "'[Ll]icense'" in entry.oracle_sql()["regex_search"]
