"""Personal data by weak supervision, with DataFrame functions only.

Patterns, gazetteers (known key prefixes, given names) and context (key words, titles before a
name) propose spans. Four labelers vote on each (private, not private, or no vote): a checker
of the format, a gazetteer of known domains, prefixes, codes and names, a reader of the words
around the span, and a judge of its characters (of a name: of the word that follows). About a
name each of them can say no: it holds or ends in a word of offices, bodies, places or brands,
a place word stands before it, such a word or "of" comes after it. Expectation-maximisation over the counts of
vote patterns estimates, kind by kind, how reliable each labeler is and how likely each span
is private. Every labeler starts with ``TRUST`` imagined votes at its seed reliability, so a
kind with few spans follows the seeds and one with many follows its data. A logistic span
classifier is then trained on those likelihoods over the spans' features. Both see only counts
by vote pattern and feature (``CELLS`` rows at most, whatever the input), so the driver holds
no span. Well-formed spans of the four base kinds always stay; the classifier decides about
the others: secrets, local phone numbers, names, and base patterns that fail their check.

Positions are code points, ends are exclusive. They come from the lengths of what stands
between matches, summed block by block inside the row: no span leaves its row.

Defined cases: a null text is an empty one; a document without spans has empty lists (and the
digest of the empty string); equal rows give equal results; an empty table trains nothing and
accepts base spans only; a text of any length is read whole, in time in proportion to it and,
for spans, to their number by its square root; other columns are ignored, or kept by ``mask``
whatever their names.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, let, packed, unpacked

#: Base kinds in their order, then those that the method adds.
KINDS = ("email", "ip", "card", "phone", "secret", "local_phone", "name")
#: Gazetteers.
DOMAINS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info")
COUNTRY = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "86", "91")
KEY_PREFIXES = ("sk-", "ghp_", "gho_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "AKIA", "AIza", "eyJ")
PLACEHOLDERS = ("example", "changeme", "placeholder", "your", "xxxx", "0000", "1234567", "insert", "dummy")
GIVEN_NAMES = (
    "James", "John", "Robert", "Michael", "William", "David", "Richard", "Joseph", "Thomas", "Charles", "Christopher", "Daniel",
    "Matthew", "Anthony", "Steven", "Andrew", "Kenneth", "Kevin", "Brian", "George", "Edward", "Ronald", "Timothy", "Jason",
    "Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Nancy", "Lisa",
    "Margaret", "Sandra", "Ashley", "Kimberly", "Emily", "Donna", "Michelle", "Laura", "Helen", "Helena", "Rachel", "Emma",
    "Olivia", "Sophia", "Peter", "Paul", "Anna", "Maria", "Martin", "Stefan", "Thorsten", "Hans", "Klaus", "Jürgen",
    "Wolfgang", "Dieter", "Uwe", "Heinz", "Ursula", "Monika", "Petra", "Sabine", "Renate", "Ingrid", "Katrin", "Jean",
    "Pierre", "Michel", "Philippe", "Nicolas", "François", "Jacques", "Marie", "Sophie", "Nathalie", "Isabelle", "Camille", "Chloé",
    "Carlos", "Juan", "José", "Antonio", "Francisco", "Javier", "Miguel", "Pablo", "Carmen", "Ana", "Luis", "Lucía",
    "Marta", "Elena", "Pilar", "Giovanni", "Giulia", "Marco", "Francesca", "Ivan", "Olga", "Natasha", "Dmitri", "Mohammed",
    "Fatima", "Ahmed", "Ali", "Priya", "Rahul", "Wei", "Yuki", "Kenji", "Lars", "Erik", "Ingeborg", "Anders",
)
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame")
#: Words written large beside a title, a key word or a given name that don't name a person: offices, bodies, places, the calendar, brands.
ROLES = ("President", "Chairman", "Chairwoman", "Chair", "Speaker", "Secretary", "Minister", "Ambassador", "Senator", "Doctor", "Doktor", "Professor", "Justice", "Mayor")
NO_PERSON = (
    *ROLES,
    "Director", "Manager", "Officer", "Bürgermeister", "Präsident", "Ministre", "Presidente", "Right", "Order", "Office", "Council", "Committee",
    "Board", "Court", "Department", "Ministry", "Team", "Sales", "Support", "Service", "Services", "Customer", "Press", "Media",
    "Marketing", "Security", "Human", "Resources", "Accounting", "Reception", "Company", "Group", "Bank", "Inc", "Ltd", "Corp",
    "Llc", "Gmbh", "Verein", "Foundation", "Institute", "University", "College", "School", "Schule", "Hospital", "Clinic", "Church",
    "Cathedral", "Museum", "Library", "Theatre", "Hotel", "Stadium", "Airport", "Station", "Bahnhof", "Street", "Straße", "Avenue",
    "Road", "Lane", "Square", "Platz", "Plaza", "Bridge", "Brücke", "Park", "Garden", "Island", "Islands", "Insel",
    "Lake", "River", "Bay", "Beach", "Valley", "Mountain", "Mount", "Hill", "Hills", "Falls", "Forest", "County",
    "City", "Town", "Village", "District", "State", "Province", "Republic", "Kingdom", "Minnesota", "Texas", "California", "Florida",
    "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday", "January", "February", "March", "April", "June",
    "July", "August", "September", "October", "November", "December", "Prize", "Award", "Medal", "Cup", "Act", "Bill",
    "Edition", "Version", "Chapter", "Section", "Article", "Note", "Everyone", "Nobody", "Anyone", "The", "This", "That",
    "Our", "Your", "Pepper", "Martens", "Coffee", "Clean", "Muscle", "Butterworth", "Potato", "Who", "Strangelove", "Robot",
)


def _any(words: tuple[str, ...]) -> str:
    """A pattern of any of the words, by first letter, so that a wrong one fails at once."""
    heads = sorted({w[0] for w in words})
    return "(?:" + "|".join(f"{h}(?:{'|'.join(sorted((w[1:] for w in set(words) if w[0] == h), key=lambda w: (-len(w), w)))})" for h in heads) + ")"


_HEAD = rf"(?:{_any(TITLES)}\.?\x20(?:{_any(ROLES)}\x20){{0,2}}|(?i:my name is|signed by|contact:)\x20)"
_PARTICLE = r"(?:\p{Lu}\.|van|von|der|de|del|di|da)\x20"
_LARGE = r"\p{Lu}\p{Ll}+(?:['’-]\p{Lu}\p{Ll}+)?"
#: Before a name: what speaks of a person, and what speaks of a place.
_PERSON = rf"(?:(?<![\p{{L}}0-9])(?:{_any(TITLES)}\.?|{_any(ROLES)})|(?i:\b(?:name is|signed by|contact:|dear|regards,|sincerely,|author|by|with|met|told|asked|and)))\x20$"
_PLACE = r"(?i)\b(?:the|a|an|saint|st\.?|san|santa|port|fort|mount|lake|cape|in|near|at|via)\x20$"
#: After a name: what a person does, and what only a place or a body is followed by.
_DOES = r"^(?:,?\x20(?:was|is|has|had|said|says|wrote|writes|lives|lived|asked|told|will|signed|called|works|worked)\b|['’]s\x20)"
_BODY = rf"^[\x20-](?:of\b|(?i:{'|'.join(sorted(set(NO_PERSON) - {'The', 'This', 'That', 'Who', 'Our', 'Your', 'Right', 'Clean', 'March', 'April', 'June', 'August', 'Note', 'Act', 'State', 'Chair', 'Bill', 'Support'}))})(?!\p{{L}}))"
_KEY = r"(?i:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key)\x20{0,3}[=:]\x20{0,3}[\"']?"
_KEY_CHAR = "[A-Za-z0-9_/+~-]"
#: The patterns. Possessive loops and look-behinds keep them linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": rf"(?:{_KEY}(?=[A-Za-z0-9_/+.~-]{{12}})|(?<!{_KEY_CHAR})(?=(?:{'|'.join(KEY_PREFIXES)}){_KEY_CHAR}{{12}})){_KEY_CHAR}++(?:\.{_KEY_CHAR}++)*+={{0,2}}+",
    "local_phone": r"(?<![0-9+(] ?)\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![\x20-]?[0-9])",
    "name": rf"(?:(?<![\p{{L}}0-9]){_HEAD}|(?<![\p{{L}}0-9])(?={_any(GIVEN_NAMES)}\x20(?:{_PARTICLE})?\p{{Lu}})){_LARGE}(?:\x20(?:{_PARTICLE}){{0,2}}{_LARGE})?(?![\p{{L}}0-9])",
}
#: What stands before the private part of a match.
HEADS = {"secret": f"^{_KEY}", "name": f"^{_HEAD}"}
#: A text without this can't hold the kind.
NEEDS = {
    "email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]{2}|[0-9][\x20-][0-9]", "phone": "+", "secret": rf"[=:]|{'|'.join(KEY_PREFIXES)}",
    "local_phone": r"[0-9]{3}\)?[\x20.-][0-9]{3}", "name": rf"(?<![\p{{L}}0-9])(?:{_any((*TITLES, *GIVEN_NAMES))}\.?\x20|(?i:my name is|signed by|contact:))",
}
CUES = r"(?i)(mail|e-mail|contact|call|phone|tel|fax|mobile|host|addr|login|from|card|visa|pay|account|token|secret|key|passw|name|signed|dear)"
COUNTER = r"(?i)(version|ver\.|v\.|isbn|issn|page|section|sect\.|no\.|part|serial|sku)\W{0,3}$"
AROUND = 24
#: Most rows of counts: kinds, 2 x 3 x 3 x 3 vote patterns, 4 x 3 x 3 feature cells.
CELLS = len(KINDS) * 54 * 36
#: Seed reliability of each labeler, and how many imagined votes stand for it.
SEED = (0.9, 0.8, 0.8, 0.7)
TRUST = 20.0
ROUNDS = 40
_BLOCK = 256
_PIECE = 1024


def running(values: Column, start: int, step: Callable[[Column, Column], Column]) -> Column:
    """Running sums or maxima of an array of longs: whole blocks first, then inside the block."""
    zero = F.lit(start).cast("long")
    block = F.lit(_BLOCK)
    blocks = F.transform(
        F.sequence(F.lit(0), F.greatest((F.size(values) - 1) / block, F.lit(0)).cast("int")),
        lambda b: F.aggregate(F.slice(values, b * block + 1, block), zero, step),
    )

    def at(whole: Column, i: Column) -> Column:
        before = F.aggregate(F.slice(whole, F.lit(1), (i / block).cast("int")), zero, step)
        return F.aggregate(F.slice(values, i - i % block + 1, i % block + 1), before, step)

    return let(blocks, lambda whole: F.transform(values, lambda _, i: at(whole, i)))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def well_formed(kind: str, match: Column) -> Column:
    digits = _digits(match)
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        small = lambda part: F.length(F.regexp_replace(part, "^0+(?=.)", "")) <= 3
        value = lambda part: F.when(small(part), part.cast("int")).otherwise(F.lit(256))
        return F.forall(F.split(match, r"\."), lambda part: value(part) <= 255)
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "secret":
        return match.rlike("[0-9]") & match.rlike("[A-Za-z]")
    if kind == "name":
        return ~match.rlike(rf"(?<!\p{{L}}){_any(NO_PERSON)}(?!\p{{L}})")
    return ~digits.rlike("^[01]")


def _known(kind: str, match: Column) -> Column:
    """The gazetteer's vote."""
    vote = lambda c: F.when(c, "1").otherwise("0")
    digits = _digits(match)
    if kind == "email":
        return vote(F.lower(F.substring_index(match, ".", -1)).isin(*DOMAINS))
    if kind == "ip":
        return vote(~match.rlike(r"^(?:0|10|127|22[4-9]|23[0-9]|24[0-9]|25[0-5]|192\.168)\."))
    if kind == "card":
        return vote(match.rlike("^[3-6]") & F.length(digits).between(13, 19))
    if kind == "phone":
        return vote(F.exists(F.array(*map(F.lit, COUNTRY)), lambda c: digits.startswith(c)))
    if kind == "secret":
        return F.when(match.rlike("(?i)" + "|".join(PLACEHOLDERS)), "0").when(match.rlike("^(?:" + "|".join(KEY_PREFIXES) + ")"), "1").otherwise("x")
    if kind == "name":
        return F.when(match.rlike(rf"(?<!\p{{L}}){_any(NO_PERSON)}$"), "0").when(match.rlike(rf"^{_any(GIVEN_NAMES)}(?!\p{{L}})"), "1").otherwise("x")
    return F.when(digits.rlike("^.11"), "0").otherwise("x")


def _votes(kind: str, match: Column, before: Column, after: Column) -> Column:
    digits = F.length(_digits(match))
    distinct = F.size(F.array_distinct(F.split(match if kind == "secret" else _digits(match), "")))
    checked = F.when(well_formed(kind, match), "1").otherwise("0")
    context = F.when(before.rlike(COUNTER), "0").when(before.rlike(CUES), "1").otherwise("x")
    if kind == "name":
        context = F.when(before.rlike(_PERSON), "1").when(before.rlike(_PLACE) | before.rlike(COUNTER), "0").otherwise("x")
        shape = F.when(after.rlike(_BODY), "0").when(after.rlike(_DOES), "1").otherwise("x")
    elif kind == "secret":
        shape = F.when(distinct < 5, "0").when(distinct >= 8, "1").otherwise("x")
    elif kind == "email":
        shape = F.lit("x")
    else:
        shape = F.when(digits < 4, "x").when(distinct < 4, "0").otherwise("1")
    return F.concat(checked, _known(kind, match), context, shape)


def _near(char: Column) -> Column:
    return F.when(char == "", "-").when(char.rlike(r"[\p{L}0-9_]"), "w").otherwise("o")


def _span(n: int, kind: str, gaps: Column, starts: Column):
    """Match and place in the row to a span, from the gaps between matches and matches' starts."""

    def made(m: Column, gap: Column, after: Column, start: Column) -> Column:
        value = F.regexp_replace(m, HEADS[kind], "") if kind in HEADS else m
        # a span's context ends where its private part begins
        before = F.right(F.concat(F.right(gap, F.lit(AROUND)), F.left(m, F.length(m) - F.length(value))) if kind in HEADS else gap, F.lit(AROUND))
        end = start + F.length(m)
        votes = _votes(kind, value, before, F.left(F.coalesce(after, F.lit("")), F.lit(AROUND)))
        size = F.when(F.length(value) < 12, "s").when(F.length(value) < 16, "m").when(F.length(value) < 24, "l").otherwise("x")
        return F.struct(
            F.lit(n).alias("kind"),
            (end - F.length(value)).cast("long").alias("start"),
            end.cast("long").alias("end"),
            (F.substring(votes, 1, 1).eqNullSafe(F.lit("1")) if n < 4 else F.lit(False)).alias("base"),
            votes.alias("votes"),
            F.concat(size, _near(F.right(before, F.lit(1))), _near(F.left(after, F.lit(1)))).alias("cell"),
        )

    return lambda m, i: made(m, F.get(gaps, i), F.get(gaps, i + 1), F.get(starts, i))


def _found(n: int, kind: str) -> Column:
    """All spans of a kind in the column ``t``."""
    pattern = PATTERNS[kind]
    text = F.col("t")
    may = F.contains(text, F.lit(NEEDS[kind])) if len(NEEDS[kind]) == 1 else text.rlike(NEEDS[kind])
    matches = F.when(may, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))

    def spans(m: Column) -> Column:
        def steps(g: Column) -> Column:
            """What lies between one match's start and the one before."""
            return F.transform(m, lambda _, i: (F.length(F.get(g, i)) + F.when(i > 0, F.length(F.get(m, i - 1))).otherwise(F.lit(0))).cast("long"))

        add = lambda a, x: a + x
        placed = lambda g: let(let(steps(g), lambda s: running(s, 0, add)), lambda p: F.transform(m, _span(n, kind, g, p)))
        some = let(F.split(text, pattern, -1), placed)
        return F.when(F.size(m) > 0, some).otherwise(F.array().cast(SPANS))

    return let(matches, spans)


SPANS = "array<struct<kind:int,start:bigint,end:bigint,base:boolean,votes:string,cell:string>>"


def candidates(docs: DataFrame, names: list[str]) -> DataFrame:
    """``row`` (a struct of the columns ``names``) and ``spans``: kind number, start, end, whether
    it is a well-formed base span, the votes, and the feature cell."""
    df = docs.select(*([packed(names)] if names else []), F.coalesce("text", F.lit("")).alias("t"))
    spans = F.concat(*[_found(n, kind) for n, kind in enumerate(KINDS)])
    return df.select(*(["row"] if names else []), spans.alias("spans"))


def train(spans: DataFrame) -> dict[str, float]:
    """Weights of the span classifier from ``spans`` (a column of that name, as in ``candidates``)."""
    cells = (
        spans.select(F.explode("spans").alias("s"))
        .groupBy(F.col("s.kind").alias("kind"), F.col("s.votes").alias("votes"), F.col("s.cell").alias("cell"))
        .count()
        .collect()
    )
    return fit([(r["kind"], r["votes"], r["cell"], r["count"]) for r in sorted(cells)])


def fit(cells: list[tuple[int, str, str, int]]) -> dict[str, float]:
    """Expectation-maximisation, then logistic regression on its posteriors; counts only."""
    patterns: dict[tuple[int, str], float] = defaultdict(float)
    for kind, votes, _, n in cells:
        patterns[kind, votes] += n
    if not patterns:
        return {}
    right = {(who, v, y): TRUST * (SEED[who] if int(v) == y else 1 - SEED[who]) for who in range(4) for v in "01" for y in (0, 1)}
    kinds = sorted({kind for kind, _ in patterns})
    post: dict[tuple[int, str], float] = {}
    for _ in range(ROUNDS):
        prior = {k: [1.0, 1.0] for k in kinds}
        says = {(k, *x): n for k in kinds for x, n in right.items()}
        for (kind, votes), y in post.items():
            n = patterns[kind, votes]
            prior[kind][1] += n * y
            prior[kind][0] += n * (1 - y)
            for who, v in enumerate(votes):
                if v != "x":
                    says[kind, who, v, 1] += n * y
                    says[kind, who, v, 0] += n * (1 - y)
        for kind, votes in patterns:
            odds = math.log(prior[kind][1] / prior[kind][0])
            for who, v in enumerate(votes):
                if v != "x":
                    share = [says[kind, who, v, y] / (says[kind, who, "0", y] + says[kind, who, "1", y]) for y in (0, 1)]
                    odds += math.log(share[1]) - math.log(share[0])
            post[kind, votes] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return _logistic([(features(kind, votes, cell), post[kind, votes], kind, n) for kind, votes, cell, n in cells])


def _logistic(rows: list[tuple[list[str], float, int, int]]) -> dict[str, float]:
    """Ridge weights by Newton's method; each kind weighs alike, so that a rare one is learnt as well."""
    names = sorted({f for x, *_ in rows for f in x})
    place = {f: i for i, f in enumerate(names)}
    held: dict[int, float] = defaultdict(float)
    for _, _, kind, n in rows:
        held[kind] += n
    x, y, share = np.zeros((len(rows), len(names))), np.zeros(len(rows)), np.zeros(len(rows))
    for i, (has, likely, kind, n) in enumerate(rows):
        x[i, [place[f] for f in has]] = 1
        y[i], share[i] = likely, 1000.0 * n / held[kind]
    weights = np.zeros(len(names))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (share * (y - p)) - 0.1 * weights
        curve = (x * (share * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(names))
        weights = weights + np.clip(np.linalg.solve(curve, slope), -2, 2)
    return dict(zip(names, weights.tolist(), strict=True))


def features(kind: int, votes: str, cell: str) -> list[str]:
    return [f"k{kind}", f"s{cell[0]}", f"b{cell[1]}", f"a{cell[2]}", *(f"{kind}v{i}{v}" for i, v in enumerate(votes) if v != "x")]


def accepted(span: Column, weights: dict[str, float]) -> Column:
    """Whether the classifier takes the span; well-formed base spans always stay."""
    if not weights:
        return span["base"]
    table = F.create_map(*[F.lit(x) for pair in sorted(weights.items()) for x in pair])
    names = [F.concat(F.lit("k"), span["kind"].cast("string"))]
    names += [F.concat(F.lit(p), F.substring(span["cell"], i + 1, 1)) for i, p in enumerate("sba")]
    names += [F.concat(span["kind"].cast("string"), F.lit(f"v{i}"), F.substring(span["votes"], i + 1, 1)) for i in range(4)]
    score = sum((F.coalesce(F.try_element_at(table, x), F.lit(0.0)) for x in names), F.lit(0.0))
    return span["base"] | (score > 0)


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, comma-joined."""
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"])))
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Per document: counts of base kinds, the digest of base spans, all spans and their number."""
    df = found.select("row.doc_id", F.filter("spans", lambda s: s["base"]).alias("base"), F.filter("spans", lambda s: accepted(s, weights)).alias("all"))
    count = lambda n: F.size(F.filter("base", lambda s: s["kind"] == F.lit(n))).cast("long").alias(f"n_{KINDS[n]}")
    return df.select(
        "doc_id",
        *[count(n) for n in range(4)],
        F.sha2(spans_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        spans_text(F.col("all")).alias("spans"),
        F.size("all").cast("long").alias("n_spans"),
        (F.size("all") > 0).alias("has_personal_data"),
    )


def find(docs: DataFrame) -> DataFrame:
    """The whole operator: candidates are found once and kept without their texts."""
    found = keep(candidates(docs, ["doc_id"]), "pii-spans")
    return report(found, train(found))


def _between(blocks: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` of a text cut into blocks of ``_PIECE``: only the blocks
    that hold them are read, so that many cuts of a long text take time in proportion to it."""
    first = F.floor(start / F.lit(_PIECE)).cast("int")
    some = F.slice(blocks, first + 1, (F.floor((end - 1) / F.lit(_PIECE)).cast("int") - first + 1))
    return F.when(end > start, F.substring(F.array_join(some, ""), (start % F.lit(_PIECE) + 1).cast("int"), (end - start).cast("int"))).otherwise(F.lit(""))


def masked(text: Column, spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """``text`` with the union of ``spans`` replaced: overlapping ones are one, called after the
    first of them (the longest of those that start there)."""
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), s["kind"].alias("kind"))))
    name = lambda k: F.element_at(F.array(*[F.lit(f"<{x.upper()}>") for x in kinds]), k + 1)
    zero = F.lit(0).cast("long")

    def firsts(o: Column, reach: Column) -> Column:
        """The first span of each run of overlapping ones, and how far all before it reach."""
        each = F.transform(o, lambda s, i: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), F.when(i > 0, F.get(reach, i - 1)).otherwise(zero).alias("past")))
        return F.filter(each, lambda s, i: (i == 0) | (s["start"] >= s["past"]))

    def joined(heads: Column, reach: Column, blocks: Column, whole: Column) -> Column:
        parts = F.transform(heads, lambda s: F.concat(_between(blocks, s["past"], s["start"]), name(s["kind"])))
        return F.concat(F.array_join(parts, ""), _between(blocks, F.element_at(reach, -1), F.length(whole).cast("long")))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))
    further = lambda a, x: F.greatest(a, x)
    out = let(ordered, lambda o: let(let(F.transform(o, lambda s: -s["less"]), lambda e: running(e, 0, further)), lambda r: let(firsts(o, r), lambda h: let(blocks, lambda b: joined(h, r, b, text)))))
    return F.when(F.size(spans) > 0, out).otherwise(text)


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with the union of all accepted spans replaced by kinds in angle brackets.

    Overlapping spans are one, called after the first; no code point of an accepted span stays.
    Rows are read once and kept with their spans. A null text stays null; all columns stay,
    whatever their names.
    """
    names = docs.columns
    found = keep(candidates(docs, names), "pii-rows")
    weights = train(found)
    own = found.select("row", F.filter("spans", lambda s: accepted(s, weights)).alias("all"))
    return own.select(*unpacked(names, text=masked(F.col("row.text"), F.col("all"))))
