"""Toxicity with noisy-channel deobfuscation.

Suspicious spots (tokens with letters beside digits or signs, or with a letter twice running;
letters set apart by signs or spaces) become a lattice of what each character may stand for;
Viterbi decoding under a character language model restores the likeliest word, or words where
letters are set apart. Spots whose lattice holds none of the classifier's words are not decoded,
which changes no result. The model's trigram
counts come from every document (one vector of counts a task, added up); its alphabet is
fixed, so it has ``SIZE ** 3`` cells whatever the input. The restored words, and those written
plainly, are scored by a logistic classifier. Its features are words, and stems that two or more
words of a text begin with, so that inflected words count together; they are chosen and
weighed on labelled rows outside the held-out fold, ``TRAIN_ROWS`` of them at most (drawn by a
hash). A word or stem is chosen if so many toxic texts having it can't be chance, given how many
of its kind (words, or stems of its length) were looked at.

Ids, sources, languages and labels are never inputs of a score.

Defined cases: a null or empty text gets the score of a text without any known word; equal
texts get equal scores; without usable labels every score is the smoothed base rate; an
empty table gives an empty result; a text of any length is read whole; repeated rows count
each; other columns are ignored, or kept by ``reject`` whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import guarded, keep, let, packed, unpacked

FOLDS = 5
TRAIN_ROWS = 20_000
#: Least toxic rows of a feature, least lift, and how many features of a kind may be expected by accident at most.
MIN_SUPPORT, MIN_LIFT, CHANCE = 3, 8.0, 0.5
#: Lengths of stems.
STEMS = (4, 5, 6, 7)
#: The model's letters (0 is any boundary) and what signs may stand for.
LETTERS = "abcdefghijklmnopqrstuvwxyzàâäáçéèêëíìîïñóôöúùûüß"
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "*": "aeiou", "#": "h",
}
SIZE = len(LETTERS) + 1
LEET_COST, KEEP_COST, DOUBLE_COST = 1.0, 0.1, 1.5
LEXICON_SHARE = 1e-4
_INDEX = {c: i + 1 for i, c in enumerate(LETTERS)}
_SIGNS = re.escape("".join(c for c in LEET if not c.isdigit()))
_TOKEN = frozenset(LETTERS) | frozenset(LEET)
#: A letter beside a digit or sign, or twice running: the whole token is suspicious.
SUSPECT = re.compile(rf"[{LETTERS}][0-9{_SIGNS}]|[0-9{_SIGNS}][{LETTERS}]|([{LETTERS}])\1")
#: Single characters set apart by anything: signs stand for letters, or only set apart.
APART = (
    re.compile(rf"(?<![\w{_SIGNS}])[\w{_SIGNS}](?:[^\w{_SIGNS}]++[\w{_SIGNS}](?![\w{_SIGNS}])){{2,}}+"),
    re.compile(r"(?<!\w)\w(?:\W++\w(?!\w)){2,}+"),
)
#: Letters that are words of their own, and the cost of a boundary among letters set apart.
ONE_LETTER = frozenset("aeiouyàèéóú")
SPLIT_COST = 1.0


# --- character language model -------------------------------------------------------------


def _table() -> np.ndarray:
    table = np.zeros(0x250, np.int64)
    for c, i in _INDEX.items():
        table[ord(c)] = i
    return table


def trigrams(text: str, table: np.ndarray) -> np.ndarray:
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.where(codes < len(table), table[np.minimum(codes, len(table) - 1)], 0)
    codes = np.concatenate(([0, 0], codes, [0]))
    codes = (codes[:-2] * SIZE + codes[1:-1]) * SIZE + codes[2:]
    return np.bincount(codes, minlength=SIZE**3)


def char_counts(docs: DataFrame) -> np.ndarray:
    """Trigram counts over all texts: a vector a task, then one sum a cell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, total = _table(), np.zeros(SIZE**3, np.int64)
        for batch in batches:
            texts, held = [], 0
            for text in batch["text"].tolist():
                texts.append(text)
                held += len(text)
                if held > 1 << 20:
                    total += trigrams(" ".join(texts), table)
                    texts, held = [], 0
            if texts:
                total += trigrams(" ".join(texts), table)
        cell = np.flatnonzero(total)
        if len(cell):
            yield pd.DataFrame({"cell": cell, "n": total[cell]})

    counted = docs.select("text").where("text is not null").mapInPandas(run, "cell long, n long")
    out = np.zeros(SIZE**3)
    for r in counted.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out


def costs(counts: np.ndarray) -> np.ndarray:
    """Negative log probability of a character after two others, backed off to shorter ones."""
    three = counts.reshape(SIZE, SIZE, SIZE)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 1) / (one.sum() + SIZE)
    p2 = (two + 5 * p1[None, :]) / (two.sum(1, keepdims=True) + 5)
    p3 = (three + 5 * p2[None, :, :]) / (three.sum(2, keepdims=True) + 5)
    return -np.log(p3).astype(np.float32)


# --- decoding -----------------------------------------------------------------------------


def lattice(spot: str) -> list[list[tuple[str, float]]]:
    """Per run of one character: what it may stand for, with its channel cost."""
    out, at = [], 0
    while at < len(spot):
        to = at
        while to < len(spot) and spot[to] == spot[at]:
            to += 1
        c, n = spot[at], to - at
        arcs = []
        for letters, cost in ((c, KEEP_COST if n < 3 else 0.5),) if c in _INDEX else ((LEET.get(c, ""), LEET_COST),):
            for rank, x in enumerate(letters):
                cost += 0.7 * (rank > 0)
                arcs.append((x, cost if n < 2 or c not in _INDEX else cost + DOUBLE_COST / 2))
                if n > 1:
                    arcs.append((x + x, cost + (DOUBLE_COST if n > 2 else 0.0)))
        if c in "*#|!(+" and c not in _INDEX:
            arcs.append(("", 4.0))
        out.append(arcs or [("", 0.0)])
        at = to
    return out


def decode(spot: str, cost: np.ndarray, splits: list[float] | None = None) -> str:
    """The likeliest word under channel and language model (Viterbi over character pairs).

    With ``splits``, the costs of a boundary before each run, words with spaces between. Texts are linked backwards, so a long spot costs in proportion to its runs.
    """
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for k, arcs in enumerate(lattice(spot)):
        for (a, b), (so_far, text) in list(states.items()) if splits and k else ():
            total = so_far + splits[k] + float(cost[a, b, 0])
            if b and ((b, 0) not in states or total < states[b, 0][0]):
                states[b, 0] = (total, (text, " "))
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (so_far, text) in states.items():
            for letters, channel in arcs:
                x, y, total = a, b, so_far + channel
                for c in letters:
                    i = _INDEX[c]
                    total += float(cost[x, y, i])
                    x, y = y, i
                if (x, y) not in after or total < after[x, y][0]:
                    after[x, y] = (total, (text, letters))
        states = after
    ends = [(t + float(cost[a, b, 0]), text) for (a, b), (t, text) in states.items()]
    least = min(t for t, _ in ends)
    return min(_spelled(text) for t, text in ends if t == least)


def _spelled(text: tuple | None) -> str:
    out = []
    while text:
        text, letters = text
        out.append(letters)
    return "".join(reversed(out))


def cuts(spot: str) -> list[int]:
    """Where the runs of ``lattice`` start, and the end."""
    return [0, *(i for i in range(1, len(spot)) if spot[i] != spot[i - 1]), len(spot)]


# --- words --------------------------------------------------------------------------------


class Finder:
    """Which of the chosen words and stems a text has, plainly or restored."""

    def __init__(self, words: list[str], stems: list[str], cost: np.ndarray):
        import ahocorasick

        self.words, self.stems, self.cost, self.memo = words, stems, cost, {}
        self.place = {w: i for i, w in enumerate(words)}
        self.root = {w: len(words) + i for i, w in enumerate(stems)}
        self.lengths = sorted({len(w) for w in stems})
        self.prefixes = {w[:i] for w in (*words, *stems) for i in range(len(w) + 1)}
        self.machine = ahocorasick.Automaton()
        for w in {*words, *stems}:
            self.machine.add_word(w, w)
        if self.prefixes:
            self.machine.make_automaton()

    def __call__(self, text: str) -> set[int]:
        if not text or not self.prefixes:
            return set()
        low = text.lower()
        found, begun = set(), {}
        for end, w in self.machine.iter(low):
            a, b = end - len(w), end + 1
            if a >= 0 and low[a].isalpha():
                continue
            more = b < len(low) and low[b].isalpha()
            if not more and w in self.place:
                found.add(self.place[w])
            if more and w in self.root:
                begun.setdefault(self.root[w], set()).add(a + 1)
        low = low.replace("_", " ")
        done = 0
        for m in SUSPECT.finditer(low):
            if m.start() < done:
                continue
            a, done = m.start(), m.end()
            while a > 0 and low[a - 1] in _TOKEN:
                a -= 1
            while done < len(low) and low[done] in _TOKEN:
                done += 1
            self.note(self.remembered(low[a:done], self.token), a, found, begun)
        for pattern in APART:
            for m in pattern.finditer(low):
                self.note(self.remembered(m[0], self.apart), m.start(), found, begun)
        return found.union(i for i, at in begun.items() if len(at) > 1)

    def note(self, got: set[int], at: int, found: set[int], begun: dict[int, set[int]]) -> None:
        """Words are found at once; a stem counts once a place."""
        for i in got:
            if i < len(self.words):
                found.add(i)
            else:
                begun.setdefault(i, set()).add(at)

    def remembered(self, spot: str, look) -> set[int]:
        if len(spot) > 256:
            return look(spot)
        key = (look.__name__, spot)
        if key not in self.memo:
            if len(self.memo) > 100_000:
                self.memo.clear()
            self.memo[key] = look(spot)
        return self.memo[key]

    def reach(self, arcs: list[list[tuple[str, float]]], starts: range, ends: range, aims: dict[str, int]) -> set[tuple[int, int]]:
        """Stretches of a lattice that may stand for one of ``aims``; the shortest for each word and end."""
        out, nodes = set(), {}
        for k, choice in enumerate(arcs):
            if k in starts:
                nodes[""] = k
            elif not nodes and k >= starts.stop:
                break
            after: dict[str, int] = {}
            for node, start in nodes.items():
                for letters, _ in choice:
                    x = node + letters
                    if x and x in self.prefixes and after.get(x, -1) < start:
                        after[x] = start
            nodes = after
            if k + 1 in ends:
                out.update((start, k + 1) for x, start in nodes.items() if x in aims)
        return out

    def chosen(self, words) -> set[int]:
        """Chosen words among ``words``, and stems that one of them begins with."""
        words = set(words)
        stems = {self.root[w[:n]] for w in words for n in self.lengths if len(w) > n and w[:n] in self.root}
        return stems.union(self.place[w] for w in words if w in self.place)

    def token(self, spot: str) -> set[int]:
        """Words of a token; digits and signs at its ends may belong to the word or not."""
        at = cuts(spot)
        letters = [k for k, i in enumerate(at[:-1]) if spot[i] in _INDEX]
        arcs, starts, last = lattice(spot), range(letters[0] + 1), letters[-1] + 1
        spots = {spot[at[a] : at[b]] for a, b in self.reach(arcs, starts, range(last, len(at)), self.place)}
        # what begins with a stem goes on to the end of the word
        spots |= {spot[at[a] : at[last]] for a, _ in self.reach(arcs, starts, range(1, len(at)), self.root)}
        # letters that are all doubled say that none of them is meant twice
        spots |= {"".join(x[i] for i in cuts(x)[:-1]) for x in spots if all(b - a > 1 for a, b in zip(cuts(x), cuts(x)[1:]))}
        return self.chosen(decode(x, self.cost) for x in spots if x)

    def apart(self, spaced: str) -> set[int]:
        """Words of letters set apart: all of them, without one-letter words at the ends, or split."""
        parts = re.split(rf"([^\w{_SIGNS}]+)" if APART[0].fullmatch(spaced) else r"(\W+)", spaced)
        spot, gaps = "".join(parts[::2]), [0, *map(len, parts[1::2])]
        if not any(c in _INDEX for c in spot):
            return set()
        at = cuts(spot)
        n = len(at) - 1
        if not self.reach(lattice(spot), range(n), range(1, n + 1), {**self.place, **self.root}):
            return set()
        heads = (0, 1) if spot[0] in ONE_LETTER else (0,)
        tails = (0, 1) if spot[-1] in ONE_LETTER else (0,)
        words = {decode(spot[a : len(spot) - b], self.cost) for a in heads for b in tails}
        least = min(gaps[1:])
        splits = [SPLIT_COST if gaps[i] == least else 0.0 for i in at[:-1]]
        return self.chosen(words.union(decode(spot, self.cost, splits).split(" ")))


def twice_begun(tokens: Column) -> Column:
    """Stems that two words or more of a text begin with, longer ones than the stem."""
    stem = lambda w: F.array(*[F.when(F.length(w) > n, F.substring(w, 1, n)) for n in STEMS])
    of_all = F.sort_array(F.filter(F.flatten(F.transform(tokens, stem)), lambda x: x.isNotNull()))
    return let(of_all, lambda s: F.array_distinct(F.filter(s, lambda x, i: F.coalesce(F.get(s, i + 1) == x, F.lit(False)))))


def unlikely(pos: int, n: int, base: float) -> float:
    """The chance that ``pos`` or more of ``n`` rows are toxic, at the base rate."""
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(base) + (n - k) * math.log1p(-base)) for k in range(pos, n + 1))


def choose(counted: DataFrame, pos: int, neg: int) -> list[str]:
    """Features of ``counted`` (``w, kind, pos, neg``) that lift can't be chance, best first. A
    stem goes if a longer one has the same rows."""
    lift = (F.col("pos") / pos) / ((F.col("neg") + 1) / (neg + 1))
    enough = counted.where(F.col("pos") + F.col("neg") >= MIN_SUPPORT)
    tried = {r["kind"]: r["count"] for r in enough.groupBy("kind").count().collect()}
    rows = enough.where((F.col("pos") >= MIN_SUPPORT) & (lift >= MIN_LIFT)).select("*", (F.col("pos") * F.log(lift)).alias("gain")).collect()
    sure = [r for r in rows if unlikely(r["pos"], r["pos"] + r["neg"], pos / (pos + neg)) * tried[r["kind"]] <= CHANCE]
    longer = {(r["w"][:-1], r["pos"], r["neg"]) for r in sure if r["kind"]}
    kept = [r for r in sure if not r["kind"] or (r["w"], r["pos"], r["neg"]) not in longer]
    return [r["w"] for r in sorted(kept, key=lambda r: (-r["gain"], r["w"]))]


def train(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[str], np.ndarray]:
    """Words, stems and weights (of each, of any and the bias last) from at most ``TRAIN_ROWS`` labelled rows of the training folds."""
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS
    rows = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold != 0)).select("doc_id", "toxic").distinct()
    n = rows.count()
    share = min(1.0, 0.97 * TRAIN_ROWS / max(n, 1))
    rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = keep(rows, "toxic-sample")
    got = docs.select("doc_id", "text").join(guarded(rows, rows.count()), "doc_id")
    token = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))
    per = keep(got.select("toxic", F.array_distinct(token).alias("w"), twice_begun(token).alias("s")), "toxic-words")
    base = per.agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg")).first()
    pos, neg = base["pos"] or 0, base["neg"] or 0
    if not pos or not neg:
        return [], [], np.array([0.0, math.log((pos + 1) / (neg + 1))])
    ones = lambda c, kind: per.select("toxic", F.explode(c).alias("w")).groupBy("w").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg")).withColumn("kind", kind)
    words = choose(ones("w", F.lit(0)).where(F.length("w") > 2), pos, neg)
    stems = choose(ones("s", F.length("w")), pos, neg)
    seen = {}
    among = lambda c, some: F.array_intersect(c, F.array(*map(F.lit, some or [""])).cast("array<string>"))
    marked = F.transform(among("s", stems), lambda x: F.concat(x, F.lit("-")))
    look = per.select("toxic", F.array_sort(F.concat(among("w", words), marked)).alias("x"))
    for r in look.groupBy("toxic", "x").count().collect():
        seen[r["toxic"], tuple(r["x"])] = r["count"]
    return words, stems, fit([*words, *(x + "-" for x in stems)], seen)


def fit(words: list[str], seen: dict[tuple[int, tuple[str, ...]], int]) -> np.ndarray:
    """Logistic weights of each word and stem, of having any at all, and the bias last."""
    place = {w: i for i, w in enumerate(words)}
    x = np.zeros((len(seen), len(words) + 2))
    y, n = np.zeros(len(seen)), np.zeros(len(seen))
    for row, ((label, have), count) in enumerate(sorted(seen.items())):
        for w in have:
            x[row, place[w]] = 1
        x[row, -2] = bool(have)
        x[row, -1] = 1
        y[row], n[row] = label, count
    weights = np.zeros(len(words) + 2)
    ridge = np.full(len(words) + 2, 0.5)
    ridge[-2:] = 0.05, 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (n * (y - p)) - ridge * weights
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-6)
        weights = weights + np.clip(np.linalg.solve(curve, slope), -3, 3)
    return weights


def probability(found: set[int], weights: np.ndarray) -> float:
    z = weights[-1] + (weights[-2] if found else 0.0) + sum(weights[i] for i in found)
    return 1 / (1 + math.exp(-min(30.0, max(-30.0, float(z)))))


def model(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
    words, stems, weights = train(docs, labels)
    counts = char_counts(docs)
    # the source model mixes the corpus with the classifier's words, so either can be restored
    counts += trigrams(" ".join((*words, *stems)), _table()) * max(1.0, counts.sum() * LEXICON_SHARE)
    return words, stems, weights, costs(counts)


def score_column(words: list[str], stems: list[str], weights: np.ndarray, cost: np.ndarray):
    """An Arrow function of the text alone."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = Finder(words, stems, cost)
        for batch in batches:
            out = [probability(find(t), weights) for t in batch.tolist()]
            yield pd.Series(out, index=batch.index, dtype="float64")

    return score


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    score = score_column(*model(docs, labels))
    out = docs.select("doc_id", score(F.coalesce("text", F.lit(""))).alias("score"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that score 0.5 or more; all columns stay."""
    score = score_column(*model(docs, labels))
    names = docs.columns
    scored = docs.select(packed(names), score(F.coalesce("text", F.lit(""))).alias("score"))
    return scored.where("score < 0.5").select(*unpacked(names))
