"""Text expressions: tokens of code and prose, lines, snippets. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word that starts with a letter, a run of digits, or a run of CJK ideographs.
RUN = r"[A-Za-z][A-Za-z0-9]*|\p{Nd}+|[\x{4e00}-\x{9fff}]+"
TRUNCATED = "…"


#: A camel-case border in a run, and characters whose runs also give characters and bigrams.
BORDER = "[a-z0-9][A-Z]|[A-Z][A-Z][a-z]"
WIDE = r"[\x{4e00}-\x{9fff}]|[\p{Nd}&&[^0-9]]"


def _bordered(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "([A-Z]+)([A-Z][a-z])", "$1 $2"), "([a-z0-9])([A-Z])", "$1 $2")


def tokenize(text: Column) -> Column:
    """Lower-case tokens in order, duplicates kept.

    ASCII runs are cut at camel-case borders; other runs give themselves, their characters
    (from two on) and their bigrams (from three on). Null gives an empty array.

    Borders are set in the whole text, and only if it has any; runs are looked at one by one
    only in texts with wide ones.
    """
    text = F.coalesce(text, F.lit(""))
    found = lambda t: F.regexp_extract_all(t, F.lit(RUN), F.lit(0))

    def one(run: Column) -> Column:
        n = F.length(run)
        chars = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(run, i, F.lit(1)))
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2)))
        wide = F.when(n > 2, F.concat(F.array(run), chars, pairs)).when(n > 1, F.concat(F.array(run), chars)).otherwise(F.array(run))
        return F.when(F.ascii(run) < 128, F.array(F.lower(run))).otherwise(wide)

    runs = found(F.when(text.rlike(BORDER), _bordered(text)).otherwise(text))
    return F.when(text.rlike(WIDE), F.flatten(F.transform(runs, one))).otherwise(F.transform(runs, F.lower))


def lines(text: Column) -> Column:
    """Lines as Python's ``split('\\n')`` gives them: a trailing newline leaves an empty last one."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def snippet(text: Column, most: int = 150) -> Column:
    return F.translate(F.substring(F.coalesce(text, F.lit("")), 1, most), "\n", " ")


def clip(text: Column, most: int) -> Column:
    return F.substring(text, 1, most)


def has_text(text: Column) -> Column:
    """True if something but (Unicode) white space is there."""
    return F.coalesce(text, F.lit("")).rlike(r"(?U)\S")


def token_estimate(chars: Column) -> Column:
    """Estimated model tokens of so many characters, cut to a whole number."""
    return (chars / F.lit(3.0) * F.lit(1.2)).cast("int")
