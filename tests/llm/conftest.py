import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and a column of a clashing name."""
    rows = [
        (1, None, None, None, None, "x"),
        (2, "", "en", "s", 0, None),
        (3, " \t\n ", "en", "s", 4, None),
        (4, "a b a b a b\na b a b a b\n\n a b\n", "en", "s", 3, None),
        (4, "a b a b a b\na b a b a b\n\n a b\n", "en", "s", 3, None),
        (5, "mail joe.x@a-b.co.uk, +1 (017) 555-7713 or 10.0.0.1 and 999.1.1.1", "en", "t", 9, None),
        (6, "card 4111 1111 1111 1111 and 4111-1111-1111-1112; token = \"24be64439e3e49cf46b2\"", "xx", "t", 9, None),
        (7, "é😀 a@b.c_d@e.f 1.2.3.4.5.6.7.8 +12 é++1 234 567 8901.", "fr", None, 9, None),
        (8, "the cat of the house " * 9000, "en", "s", 9, None),
        (None, "the of # * $ x@y.zz", "en", "s", 9, None),
        (9, "9" * 5000 + " " + "a" * 5000 + "@" + "b." * 3000 + " " + "1." * 5000, "en", "s", 9, None),
    ]
    return spark.createDataFrame([(*r[:5], r[5]) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf(request):
    return "/root/testdata/sf0.001"
