import math
import re
import time
import unicodedata
from collections import Counter

from tamarack.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, rep = len(words), len(inside)
    failed = n < 50 or 100 * rep > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), rep, failed


def rows(docs):
    measured = quality.measures(docs, ["doc_id", "lang"])
    return quality.judge(measured, quality.references(measured)).collect()


def compare(docs, found):
    want = sorted([(r["doc_id"], *brute(r["text"])) for r in docs.collect()], key=repr)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted([tuple(r[c] for c in names) for r in found], key=repr) == want


def test_counts_of_odd_rows(odd_docs):
    found = rows(odd_docs)
    compare(odd_docs, found)
    assert not any(r["kept"] for r in found if r["base_failed"])


def test_counts_of_the_fixture(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    compare(docs, rows(docs))


def test_empty_table(no_docs):
    assert rows(no_docs) == []


def test_junk_goes_and_clean_text_stays(spark):
    clean = "The cat and the dog of this house are in a garden, and it is by the sea that was for us. " * 1
    words = clean.split()
    docs = [(i, " ".join(words[(i * 7 + k * k) % len(words)] + str("") for k in range(100)), "en") for i in range(20)]
    docs.append((99, " ".join(f"{chr(65 + i % 26)}{chr(66 + i % 7)}QX{i}$$$ ###" for i in range(100)), "en"))
    found = {r["doc_id"]: r for r in rows(spark.createDataFrame(docs, "doc_id long, text string, lang string"))}
    assert not found[99]["kept"] and found[99]["char_distance"] > quality.MAX_CHAR_DISTANCE


def test_distance_against_the_formula(spark):
    from pyspark.sql import functions as F

    p, q = [1, 3, 0], [0.5, 0.25, 0.25]
    got = spark.range(1).select(quality.distance(F.array(*[F.lit(x).cast("long") for x in p]), q).alias("d")).first()["d"]
    p = [x / 4 for x in p]
    kl = lambda a, b: sum(x * math.log2(x / y) for x, y in zip(a, b, strict=True) if x)
    m = [(x + y) / 2 for x, y in zip(p, q, strict=True)]
    assert abs(got - math.sqrt((kl(p, m) + kl(q, m)) / 2)) < 1e-12


def jsd(p, q):
    m = [(x + y) / 2 for x, y in zip(p, q, strict=True)]
    kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m, strict=True) if x)
    return math.sqrt(max(0.0, (kl(p) + kl(q)) / 2))


def brute_distances(text, refs):
    classes = [0] * 6
    for c in text:
        at = 5 if c in " \t\n\x0b\f\r" else 4 if c in quality.SYMBOLS else 1 if unicodedata.category(c) == "Lu" else 2 if c in "0123456789" else 3 if c in "!\"'(),./:;?-" else 0
        classes[at] += 1
    words = [w.lower().strip(quality.TRIM) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    chars, commons = [], []
    for lang, (char_ref, word_ref) in refs.items():
        chars.append(jsd([x / len(text) for x in classes], char_ref) if text else 0)
        own = [words.count(w) / max(1, len(words)) for w in quality.COMMON[lang]]
        commons.append(jsd([*own, max(0.0, 1 - sum(own))], [*word_ref, 1 - sum(word_ref)]))
    return (min(chars) if len(text) >= quality.MIN_CHARS else None), (min(commons) if len(words) >= quality.MIN_WORDS else None)


def test_verdicts_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    measured = quality.measures(docs, ["doc_id", "lang"])
    refs = quality.references(measured)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in quality.judge(measured, refs).collect():
        char, word = brute_distances(texts[r["doc_id"]], refs)
        for got, want in ((r["char_distance"], char), (r["word_distance"], word)):
            assert (got is None) == (want is None) and (want is None or abs(got - want) < 1e-9)
        passed = (char or 0) <= quality.MAX_CHAR_DISTANCE and (word or 0) <= quality.MAX_WORD_DISTANCE
        assert r["kept"] == (passed and not r["base_failed"])


def test_verdicts_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    found = quality.judge(m := quality.measures(spark.read.parquet(f"{sf}/documents.parquet"), ["doc_id", "lang"]), quality.references(m))
    rows = found.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    good = [r["kept"] for r in rows if r["quality"] == 1 and not r["base_failed"]]
    assert sum(bad) <= 0.02 * len(bad) and sum(good) >= 0.99 * len(good)


def test_filters_over_long_texts_end(spark):
    """A filter may be pushed below the measures: the words must not be split again for each of them."""
    docs = spark.createDataFrame([(1, "the cat of a house in the sea " * 20_000, "en")], "doc_id long, text string, lang string")
    began = time.time()
    got = quality.measures(docs, ["doc_id"]).where("n_repeat_words > 10 and n_words > 5").first()
    assert got["n_words"] == 160_000 == got["n_repeat_words"] and time.time() - began < 30


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b", "en", 1, 2)], ["doc_id", "text", "lang", "a.b", "__m"])
    assert quality.measures(docs, ["doc_id", "a.b", "lang"]).first()["a.b"] == 1
