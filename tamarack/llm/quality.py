"""Quality rules by distribution divergence, with DataFrame functions only.

A document's histogram of character classes and its histogram of common words are compared
with references of each language, means over the documents of that language that earlier
means don't reject, by Jensen-Shannon distance (base 2, so 0 to 1). The nearest language
counts. The character
test needs ``MIN_CHARS`` code points and the word test ``MIN_WORDS`` words; a shorter text
passes that test. The base rules hold besides: too few words, or too many repeated windows.

Defined cases: a null text is an empty one (all counts 0, base_failed); a null or unlisted
lang adds to no reference; with no reference at all (an empty or wholly foreign table) both
tests pass; equal rows give equal results; a text of any length is read whole, in time in
proportion to it (but for a sort); other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, keep, let

#: Common words of each language.
COMMON = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "as", "was", "on", "by", "this", "from", "or", "an", "a", "are"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "que", "est", "pour", "qui", "dans", "avec", "par", "au", "sur", "ne"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no", "una", "su", "al", "es"),
}
WORDS = tuple(dict.fromkeys(w for words in COMMON.values() for w in words))
SYMBOLS = "#*$%&|<>"
PUNCTUATION = r"""[^!"'(),./:;?-]+"""
TRIM = ".,;:!?\"'()"
MIN_CHARS = 200
MIN_WORDS = 80
#: Set between the labels of sf0.1: 99.8 in 100 good documents lie below, 99.5 in 100 bad ones above.
MAX_CHAR_DISTANCE = 0.18
MAX_WORD_DISTANCE = 0.30
MIN_BASE_WORDS = 50
#: Imagined documents of ordinary prose in every reference, so that a handful of odd documents isn't a language's measure.
PRIOR_DOCUMENTS = 5
PRIOR_CHARS = (0.80, 0.025, 0.005, 0.02, 0.0, 0.15)
_SPACE = r"[\x20\x09-\x0D]+"
_LINE_WORD = r"[^\x20\x09-\x0D]"


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more: windows are sorted by a hash with
    their place in its low bits, and equal neighbours' places are joined into runs of words."""
    n = F.size(words)
    at = lambda i: F.get(words, i)
    low = (1 << 28) - 1
    code = lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))
    codes = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), code))
    same = lambda a, b: F.coalesce(F.shiftright(a.bitwiseXOR(b), 28) == 0, F.lit(False))
    held = lambda c: F.filter(c, lambda x, i: same(x, F.get(c, i - 1)) | same(x, F.get(c, i + 1)))
    # 36 bits of hash find the windows to look at; whole windows then decide
    three = lambda x: F.concat_ws(" ", at(x), at(x + 1), at(x + 2))
    place = lambda x: x.bitwiseAND(F.lit(low)).cast("int")
    named = lambda c: F.sort_array(F.transform(c, lambda x: F.struct(three(place(x)).alias("w"), place(x).alias("p"))))
    equal = lambda s, x, i: F.coalesce(x["w"] == F.get(s, i)["w"], F.lit(False))
    sure = lambda s: F.sort_array(F.transform(F.filter(s, lambda x, i: equal(s, x, i - 1) | equal(s, x, i + 1)), lambda x: x["p"]))
    gap = lambda p: F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(3)), F.lit(3)))
    total = lambda p: F.aggregate(gap(p), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(n >= 3, let(codes, lambda c: let(held(c), lambda h: let(named(h), lambda s: let(sure(s), total))))).otherwise(F.lit(0).cast("long"))


def _common(words: Column) -> Column:
    """Place in ``WORDS`` and count of each common word among ``words``, by place."""
    table = F.create_map(*[F.lit(x) for i, w in enumerate(WORDS) for x in (w, i)])
    bare = F.transform(words, lambda w: F.btrim(F.lower(w), F.lit(TRIM)))
    places = F.sort_array(F.transform(F.filter(bare, lambda w: w.isin(*WORDS)), lambda w: F.element_at(table, w)))
    ends = lambda p: F.filter(F.transform(p, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: ~x["w"].eqNullSafe(F.get(p, x["i"] + 1)))

    def counted(e: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(e, i - 1)["i"]).otherwise(F.lit(-1))
        return F.transform(e, lambda x, i: F.struct(x["w"].cast("int").alias("word"), (x["i"] - before(i)).cast("long").alias("n")))

    return let(places, lambda p: let(ends(p), counted))


def measures(docs: DataFrame, keep_columns: list[str]) -> DataFrame:
    """The base counts, ``chars`` (six class counts) and ``common`` (place in ``WORDS`` and count of
    each common word that the text has).

    Written to shared storage at once: references and verdicts then read these few numbers a
    document, and no filter on them makes the texts be measured again.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    count = lambda drop: F.length(F.regexp_replace(text, drop, "")).cast("long")
    less = lambda drop: F.length(F.translate(text, drop, "")).cast("long")
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(_LINE_WORD))
    of_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("repeat"), _common(w).alias("common")))
    df = docs.select(
        *map(col, keep_columns),
        F.struct(
            F.length(text).cast("long").alias("all"),
            less(" \t\n\x0b\f\r").alias("word_chars"),
            less(SYMBOLS).alias("unsigned"),
            count(r"[^\p{Lu}]+").alias("upper"),
            count(r"[^0-9]+").alias("digit"),
            count(PUNCTUATION).alias("punct"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("dup_lines"),
            of_words.alias("w"),
        ).alias("__m"),
    )
    m = lambda name: F.col(f"__m.{name}")
    space, signs = m("all") - m("word_chars"), m("all") - m("unsigned")
    other = m("word_chars") - m("upper") - m("digit") - m("punct") - signs
    df = df.select(
        *map(col, keep_columns),
        m("w.n").alias("n_words"),
        m("word_chars").alias("word_chars"),
        signs.alias("n_symbols"),
        m("dup_lines").alias("n_dup_lines"),
        m("w.repeat").alias("n_repeat_words"),
        F.array(other, m("upper"), m("digit"), m("punct"), signs, space).alias("chars"),
        m("w.common").alias("common"),
    )
    return keep(df, "quality-measures")


def _summed(ok: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """Per listed language: mean shares of the character classes, and of its common words."""
    total = F.aggregate("chars", F.lit(0).cast("long"), lambda a, x: a + x)
    shares = [F.sum(F.get("chars", F.lit(i)) / total).alias(f"c{i}") for i in range(6)]
    common = ok.select("lang", "n_words", F.explode("common").alias("c")).groupBy("lang", F.col("c.word").alias("word"))
    seen = {(r["lang"], r["word"]): r["n"] for r in common.agg(F.sum(F.col("c.n") / F.col("n_words")).alias("n")).collect()}
    sums = {r["lang"]: (r["n"], [r[f"c{i}"] for i in range(6)]) for r in ok.groupBy("lang").agg(F.count("*").alias("n"), *shares).collect()}
    out = {}
    for lang, (n, chars) in sums.items():
        mean = lambda total, prior: (total + PRIOR_DOCUMENTS * prior) / (n + PRIOR_DOCUMENTS)  # noqa: B023, E731
        words = [mean(seen.get((lang, WORDS.index(w)), 0.0), 0.06 / (rank + 1)) for rank, w in enumerate(COMMON[lang])]
        out[lang] = ([mean(x, p) for x, p in zip(chars, PRIOR_CHARS, strict=True)], words)
    return out


def references(measured: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """Per listed language: shares of the character classes, and of its common words.

    Means over documents, so that no long one rules; made twice, the second time without
    the documents that the first ones reject, so that junk doesn't move them. One row a
    language, and one a common word, come to the driver (``COMMON`` has four languages).
    """
    ok = measured.where(F.col("lang").isin(*COMMON) & (F.col("n_words") >= MIN_BASE_WORDS) & ~base_failed())
    refs = _summed(ok)
    return refs and (_summed(judge(ok, refs).where("kept")) or refs)


_term = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
_both = lambda p, q: (_term(p, (p + q) / 2) + _term(q, (p + q) / 2)) / 2
_sum = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def distance(counts: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance of an array of counts from an array of shares."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    terms = F.zip_with(F.transform(counts, lambda x: x / total), F.array(*map(F.lit, reference)), _both)
    return F.sqrt(F.greatest(_sum(terms), F.lit(0.0)))


def word_distance(common: str, n_words: Column, lang: str, shares: list[float]) -> Column:
    """The same for common words, all others being one class, from the words that occur:
    a word that doesn't occur adds half its share."""
    full = [0.0] * len(WORDS)
    for w, q in zip(COMMON[lang], shares, strict=True):
        full[WORDS.index(w)] = q
    table = F.array(*map(F.lit, full))
    own = F.filter(F.transform(common, lambda c: F.struct((c["n"] / n_words).alias("p"), F.get(table, c["word"]).alias("q"))), lambda c: c["q"] > 0)
    held = F.transform(
        F.array(own),
        lambda o: _sum(F.transform(o, lambda c: _both(c["p"], c["q"])))
        + (F.lit(sum(full)) - _sum(F.transform(o, lambda c: c["q"]))) / 2
        + _both(F.greatest(1 - _sum(F.transform(o, lambda c: c["p"])), F.lit(0.0)), F.lit(max(0.0, 1 - sum(full)))),
    )
    return F.sqrt(F.greatest(F.get(held, F.lit(0)), F.lit(0.0)))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_BASE_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(measured: DataFrame, refs: dict[str, tuple[list[float], list[float]]], max_char=MAX_CHAR_DISTANCE, max_word=MAX_WORD_DISTANCE) -> DataFrame:
    """``measured`` with base_failed, the two distances, and kept."""
    nearest = lambda xs: F.least(*xs) if len(xs) > 1 else xs[0]
    none = F.lit(None).cast("double")
    chars, words = [], []
    for lang, (char_ref, word_ref) in sorted(refs.items()):
        chars.append(distance(F.col("chars"), char_ref))
        words.append(word_distance("common", F.col("n_words"), lang, word_ref))
    long_enough = F.aggregate("chars", F.lit(0).cast("long"), lambda a, x: a + x) >= MIN_CHARS
    char = F.when(long_enough, nearest(chars)) if chars else none
    word = F.when(F.col("n_words") >= MIN_WORDS, nearest(words)) if words else none
    df = measured.withColumn("char_distance", char).withColumn("word_distance", word).withColumn("base_failed", base_failed())
    passed = (F.coalesce("char_distance", F.lit(0.0)) <= max_char) & (F.coalesce("word_distance", F.lit(0.0)) <= max_word)
    return df.withColumn("kept", ~F.col("base_failed") & passed)
