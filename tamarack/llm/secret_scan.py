"""Secrets by character Markov models, with DataFrame functions only.

Two models of neighbouring characters, one of random strings and one of ordinary identifiers,
are trained from labelled samples (``value``, ``random``): ``train`` takes any such table, and
``samples`` makes one of the corpus itself. There the values of well-formed base spans are
random, and long tokens made of whole words, or of numbers set apart, are ordinary; the other
long tokens have no label, and the models decide about them. A token's score is its
log-likelihood under the first model less that under the second; from ``ODDS`` on it is a
span of kind ``random``, unless it overlaps a base span.

Training sees counts of character pairs by label (``CELLS`` rows at most, whatever the input),
summed over all documents. The random model is mixed half and half with one of equal chances,
so that random strings of another alphabet than the samples' score as well; without samples of
both labels nothing is added.

Positions are code points, ends are exclusive. A text is marked in one pass a kind and cut at
the marks; positions are running sums inside the row, so no span leaves its row.

Defined cases: a null text is an empty one; a document without spans has the digest of the
empty string; equal rows give equal results; an empty table trains nothing; a text of any
length is read whole; other columns are ignored, or kept by ``mask`` whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, let, packed, unpacked
from .pii import masked, running

#: Base kinds in their order, then the one that the models add.
KINDS = ("assign", "access", "hex", "random")
_VALUE = "[A-Za-z0-9+/_.=-]"
_KEY = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
_SIGN = "[A-Za-z0-9+/_=-]"
#: Least lengths of a value, and of a token that the models judge.
LEAST = {"assign": 12, "access": 18, "hex": 16, "random": 16}
#: Runs of letters of one kind end where they can go no further, so lengths can stand in the
#: pattern; an assignment is matched at any length and dropped afterwards.
PATTERNS = {
    "assign": f"{_KEY}{_VALUE}++",
    "access": f"AKIA[A-Z0-9]{{{LEAST['access'] - 4},}}+",
    "hex": f"(?<![0-9a-f])[0-9a-f]{{{LEAST['hex']},}}+",
    "random": f"(?<!{_SIGN}){_SIGN}{{{LEAST['random']},}}+",
}
#: Words in lower case or with a capital, numbers, and signs between them.
ORDINARY = r"^[+/_=-]*(?:(?:(?:[A-Z]?[a-z]+)+|[A-Z]+|[0-9]{1,8})(?:[+/_=-]+|$))+$"
#: A text with a mark of its own gets another sign in its place, which no pattern knows either.
MARK, INSTEAD = "\x01", "\x02"
#: Characters of the models, the edge of a token first.
LETTERS = "\x00ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
SIZE = len(LETTERS)
CELLS = 2 * SIZE * SIZE
#: A random string is taken from these odds on: there is about one in so many ordinary tokens.
ODDS = math.log(1000)
#: Imagined counts of a character after any other.
PRIOR = 0.5
SPANS = "array<struct<kind:int,start:bigint,end:bigint,value:string>>"


# --- spans --------------------------------------------------------------------------------


def _none() -> Column:
    return F.array().cast(SPANS)


def _located(text: Column, kind: str) -> Column:
    """``kind, start, end, value`` of every match: one pass marks them, the marks cut the text."""
    n = KINDS.index(kind)
    cut = F.split(F.regexp_replace(text, PATTERNS[kind], f"{MARK}$0{MARK}"), MARK, -1)

    def spans(parts: Column) -> Column:
        ends = running(F.transform(parts, lambda p: F.length(p).cast("long")), 0, lambda a, x: a + x)

        def made(end: Column, i: Column) -> Column:
            found = F.get(parts, i)
            value = F.regexp_replace(found, f"^{_KEY}", "") if kind == "assign" else found
            return F.struct(F.lit(n).alias("kind"), (end - F.length(found)).alias("start"), end.alias("end"), value.alias("value"))

        return let(ends, lambda e: F.filter(F.transform(e, made), lambda s, i: (i % 2 == 1) & (F.length(s["value"]) >= LEAST[kind])))

    return F.when(text.rlike(PATTERNS[kind]), let(cut, spans)).otherwise(_none())


def apart(tokens: Column, base: Column) -> Column:
    """Those of ``tokens`` that overlap none of ``base``: all are put in order once, and each
    looks how far base spans before it reach and where the next one starts."""
    far = F.lit(1 << 60).cast("long")
    zero = F.lit(0).cast("long")
    is_base = lambda s: s["kind"] < KINDS.index("random")

    def free(all_: Column) -> Column:
        reach = running(F.transform(all_, lambda s: F.when(is_base(s), s["end"]).otherwise(zero)), 0, lambda a, x: F.greatest(a, x))
        nexts = F.reverse(running(F.reverse(F.transform(all_, lambda s: F.when(is_base(s), s["start"]).otherwise(far))), 1 << 60, lambda a, x: F.least(a, x)))
        return let(reach, lambda r: let(nexts, lambda n: F.filter(all_, lambda s, i: ~is_base(s) & (F.get(r, i) <= s["start"]) & (F.get(n, i) >= s["end"]))))

    order = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"))
    sorted_ = F.sort_array(F.transform(F.concat(base, tokens), order))
    back = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))
    return F.when((F.size(tokens) > 0) & (F.size(base) > 0), F.transform(let(sorted_, free), back)).otherwise(tokens)


def candidates(docs: DataFrame, names: list[str]) -> DataFrame:
    """``row`` (a struct of the columns ``names``), ``base`` spans and ``tokens`` apart from them."""
    text = F.translate(F.coalesce("text", F.lit("")), MARK, INSTEAD)
    rows = docs.select(packed(names), text.alias("t"))
    found = rows.select(
        "row",
        F.concat(*[_located(F.col("t"), k) for k in KINDS[:3]]).alias("base"),
        _located(F.col("t"), "random").alias("tokens"),
    )
    return found.select("row", "base", apart(F.col("tokens"), F.col("base")).alias("tokens"))


# --- models -------------------------------------------------------------------------------


def samples(found: DataFrame) -> DataFrame:
    """Labelled samples of the corpus: ``value, random``."""
    values = lambda spans, random: F.transform(spans, lambda s: F.struct(s["value"].alias("value"), F.lit(random).alias("random")))
    mixed = lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]")
    ordinary = F.filter("tokens", lambda s: s["value"].rlike(ORDINARY))
    both = F.concat(values(F.filter("base", mixed), True), values(ordinary, False))
    return found.select(F.explode(both).alias("s")).select("s.value", "s.random")


def pair_counts(labelled: DataFrame) -> np.ndarray:
    """Counts of neighbouring characters by label: ordinary, random. Characters outside
    ``LETTERS`` count as edges."""
    edged = F.concat(F.lit(LETTERS[0]), F.coalesce("value", F.lit("")), F.lit(LETTERS[0]))
    each = labelled.where("random is not null").select("random", edged.alias("v"))
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("v") - 1), lambda i: F.substring("v", i, F.lit(2))))
    out = np.zeros((2, SIZE, SIZE))
    place = {c: i for i, c in enumerate(LETTERS)}
    known = "".join(c for c in LETTERS if c not in "-\x00")
    plain = each.withColumn("v", F.regexp_replace("v", f"[^{known}-]", LETTERS[0]))
    for r in plain.select("random", pair.alias("p")).groupBy("random", "p").count().collect():
        out[int(r["random"]), place[r["p"][0]], place[r["p"][1]]] += r["count"]
    return out


def train(labelled: DataFrame) -> list[float] | None:
    """The log-likelihood ratio of every pair of characters, row by row; None without samples of
    both labels."""
    counts = pair_counts(labelled)
    if not counts[0].sum() or not counts[1].sum():
        return None
    smooth = [(c + PRIOR) / (c + PRIOR).sum(1, keepdims=True) for c in counts]
    ratio = np.log(0.5 * smooth[1] + 0.5 / SIZE) - np.log(smooth[0])
    return [round(float(x), 6) for x in ratio.ravel()]


def score(value: Column, ratios: list[float]) -> Column:
    """A token's log-likelihood ratio, edges included."""
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")  # folded once
    codes = F.transform(F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0)), lambda c: F.instr(F.lit(LETTERS[1:]), c))

    def summed(c: Column) -> Column:
        step = lambda i: F.get(table, F.coalesce(F.get(c, i - 1), F.lit(0)) * SIZE + F.coalesce(F.get(c, i), F.lit(0)))
        return F.aggregate(F.sequence(F.lit(0), F.size(c)), F.lit(0.0), lambda total, i: total + step(i))

    return let(codes, summed)


# --- results ------------------------------------------------------------------------------


def judged(found: DataFrame, ratios: list[float] | None) -> DataFrame:
    """``row, base, added``: the tokens that score ``ODDS`` or more are spans of their own."""
    more = F.filter("tokens", lambda s: score(s["value"], ratios) >= ODDS) if ratios else _none()
    return found.select("row", "base", more.alias("added"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, comma-joined."""
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"])))
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Per document: counts of base kinds, the digest of base spans, all spans and their number.

    The models are trained on ``labelled`` (``value, random``), or on the corpus's own samples.
    """
    found = keep(candidates(docs, ["doc_id"]), "secret-spans")
    df = judged(found, train(samples(found) if labelled is None else labelled))
    count = lambda n: F.size(F.filter("base", lambda s: s["kind"] == F.lit(n))).cast("long").alias(f"n_{KINDS[n]}")
    return df.select(
        "row.doc_id",
        *[count(n) for n in range(3)],
        F.sha2(spans_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        spans_text(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_random"),
        (F.size("base") + F.size("added") > 0).alias("has_secret"),
    )


def mask(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """``docs`` with the union of all spans replaced by kinds in angle brackets; a null text
    stays null, and all columns stay."""
    names = docs.columns
    found = keep(candidates(docs, names), "secret-rows")
    df = judged(found, train(samples(found) if labelled is None else labelled))
    own = df.select("row", F.transform(F.concat("base", "added"), lambda s: s.dropFields("value")).alias("all"))
    return own.select(*unpacked(names, text=masked(F.col("row.text"), F.col("all"), KINDS)))
