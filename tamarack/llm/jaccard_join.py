"""Exact n-gram Jaccard self-join with PartEnum signatures.

Two sets of sizes ``s <= t`` that link (Jaccard at least ``percent`` in 100) differ in at most
``(100 - percent) / (100 + percent) * (s + t)`` elements, and ``s`` is at least ``percent`` of
``t``. Sizes fall into bands; a set signs for its own band and, if a partner may lie there,
for the next. Inside a band the feature domain is cut into first-level parts, these into
second-level ones, and every subset of all but ``k2`` second-level parts of a part gives a
signature: the hash of the set's elements there. The numbers are chosen so that two linked
sets agree on some parts whichever elements differ; how many at least, follows from a set's
size. A subset without elements says nothing and isn't signed, except by a set that has so
many of them that a partner might agree there only. Nor does a set sign its last parts, as
long as ``AGREE`` agreements are left over.

Most signatures are one set's only. Their first bits are sorted first, without the sets and in
three bytes each, one document a set; a bit map of bounded size tells which may be another
set's too. Only these are range-sorted together with their sets, so a common one spreads over tasks.
Neighbours in that order, so often as linked sets agree at least, are compared exactly;
components of the links found make most other pairs of a signature needless. Only pairs of a
signature that lie in different components are then compared as well, if both sets have so
many such signatures (and the pair shares so many) as linked sets of their band agree on at
least: one by one where they are few. The sets of the other signatures (a
passage that many documents share, alone in its part) sign anew by their rarest elements: in
any one order of all elements, linked sets share one of the first ``n - ceil(percent n) + 1``;
the order is by how many such sets have an element of the same bucket, so common passages come
last. What these signatures leave common is one cluster where they overlap, in which a pair is
compared once: block of sets against block of sets, where a task holds two bounded blocks and
gives links that connect what all of theirs do. No link between different sets is lost, and no signature gives all its
pairs.

Defined cases: a null or empty text has an empty set, links with nothing and is its own
component; equal sets are one node; rows that share a doc_id share what it links with; a row
without doc_id has no component; a text of any length gives its whole set; an empty table
gives an empty result; other columns are ignored, or kept by ``keep_first``, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components
from .common import discard, keep, looked_up, scratch
from .shingles import mix, set_ids, sets, slices

WORDS = 4
PERCENT = 85
#: Sets up to this size enumerate subsets of second-level parts; larger ones sign whole parts.
ENUMERATE = 256
STEP = 1.5
#: Linked sets agree on so many signatures, where their sizes allow it: one suffices to find a pair,
#: more tell it from chance.
AGREE = 4
#: A signature's last bits are the number of its band.
BAND = 63
#: Signatures a part of them, and bits of the map of those that are met again, at most (32 MB): where
#: there are too many for it, more signatures pass that only one set has.
PART = 1 << 21
MAP_BITS = 28
#: So often sets with too few open signatures are left out; each time closes more signatures.
ROUNDS = 2
#: Pairs of a signature that are compared one by one; beyond, its sets are compared in blocks.
DIRECT = 1 << 8
BLOCK_SETS, BLOCK_ELEMENTS = 2048, 1 << 20
#: Sets of a block whose intersections with another block are held at once.
BLOCK_ROWS = 256
#: Buckets in which the elements of common signatures' sets are counted.
BUCKETS = 1 << 13
#: Elements that more pairs of a block share are counted by matrices, the others pair by pair.
DENSE = 256
#: Buckets of a sketch, a byte each.
SKETCH = 512
#: Documents fetched by a broadcast of their ids (8 bytes each) at most; beyond, by a join.
FETCH = 2_000_000


class Bands:
    """First size of each band, and per band: differences, parts, subsets."""

    def __init__(self, percent: int = PERCENT, most: int = 1 << 31):
        self.percent = percent
        firsts, at = [1], 1
        free = max(1, (100 + percent) // (2 * (100 - percent)))  # up to here, only equal sets link
        at = free + 1
        while at < most:
            firsts.append(at)
            at = max(at + 1, int(at * STEP))
        self.first = np.array([*firsts, at], np.int64)
        top = self.first[1:] - 1
        self.differ = (2 * top * (100 - percent)) // (100 + percent)
        self.left_out = np.where((self.differ > 0) & (top <= ENUMERATE), 1, 0)  # k2
        fewest = self.differ // (self.left_out + 1) + 1
        slack = np.where(self.differ > 0, 2 + fewest // 12, 0)
        self.parts = fewest + slack

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, sizes, "right") - 1

    def agreed(self, sizes: np.ndarray, band: np.ndarray) -> np.ndarray:
        """On so many parts of the band a set of that size agrees at least with one that links with it."""
        other = np.minimum(100 * sizes // self.percent, self.first[band + 1] - 1)
        differ = (100 - self.percent) * (sizes + other) // (100 + self.percent)
        return self.parts[band] - differ // (self.left_out[band] + 1)

    def next_too(self, sizes: np.ndarray, band: np.ndarray) -> np.ndarray:
        return 100 * sizes >= self.percent * self.first[band + 1]


def signatures(elements: np.ndarray, counts: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """All signatures of the sets, end to end by set, and how many each has."""
    return needing(elements, counts, bands)[:2]


def needing(elements: np.ndarray, counts: np.ndarray, bands: Bands) -> tuple[np.ndarray, ...]:
    """``signatures``, each set's band, and on how many it agrees at least with a set that links
    with it in its own band and in the next one (0 where it doesn't sign)."""
    own = bands.of(np.maximum(counts, 1))
    both = bands.next_too(counts, own) & (counts > 0)
    a, na, need = _signed(elements, counts, own, bands)
    chosen = np.repeat(both, counts)
    b, nb_some, need_some = _signed(elements[chosen], counts[both], own[both] + 1, bands)
    nb, need_next = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    nb[both], need_next[both] = nb_some, need_some
    out = np.empty(len(a) + len(b), np.uint64)
    ends = np.cumsum(na + nb)
    begin = ends - (na + nb)
    out[np.repeat(begin - (np.cumsum(na) - na), na) + np.arange(len(a))] = a
    out[np.repeat(begin + na - (np.cumsum(nb) - nb), nb) + np.arange(len(b))] = b
    return out, na + nb, own, need, need_next


def _signed(elements: np.ndarray, counts: np.ndarray, band: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = np.where(counts > 0, bands.parts[band], 0)
    base = np.cumsum(parts) - parts
    total = int(parts.sum())
    if not total:
        return np.zeros(0, np.uint64), np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    part = ((elements >> np.uint64(32)) * np.repeat(parts, counts).astype(np.uint64)) >> np.uint64(32)
    key = np.repeat(base, counts) + part.astype(np.int64)
    held = np.bincount(key, minlength=total)
    ends = np.cumsum(held)
    begins = ends - held
    value = mix(elements ^ np.uint64(0xA0761D6478BD642F))

    def ranged(x: np.ndarray) -> np.ndarray:
        run = np.concatenate((np.zeros(1, x.dtype), np.cumsum(x, dtype=x.dtype)))
        return run[ends] - run[begins]

    whole = ranged(value)
    doc = np.repeat(np.arange(len(counts)), parts)
    name = (np.repeat(band, parts).astype(np.uint64) << np.uint64(34)) + ((np.arange(total) - np.repeat(base, parts)).astype(np.uint64) << np.uint64(2)) + np.uint64(1)
    lists, empties = [], np.zeros(total, bool)
    subset = bands.left_out[band][doc] == 1
    if subset.any():
        second = ((value >> np.uint64(33)) * np.uint64(3)) >> np.uint64(31)
        for j in range(3):
            mine = second == np.uint64(j)
            n = held - ranged(mine.astype(np.int64))
            s = whole - ranged(np.where(mine, value, np.uint64(0)))
            lists.append((subset, n, s, name + np.uint64(j)))
            empties |= subset & (n == 0)
    lists.append((~subset, held, whole, name))
    empties |= ~subset & (held == 0)
    blank = np.bincount(doc[empties], minlength=len(counts))
    agreed = bands.agreed(counts, band)
    short = blank >= agreed
    every = short[doc]
    # of the parts that linked sets agree on, those that this one doesn't sign may be without elements
    need = np.where(short, 1, agreed - blank)
    # whichever set of a pair signs fewer parts, all others may be agreed on but for AGREE
    signing = (np.arange(total) - base[doc]) < (bands.parts[band] - np.maximum(need - AGREE, 0))[doc]
    out, rows = [], []
    for where, n, s, tag in lists:
        take = where & ((n > 0) | every) & signing
        value = mix(mix(s[take] + n[take].astype(np.uint64)) ^ mix(tag[take] * np.uint64(0xE7037ED1A0B428DB)))
        out.append((value & ~np.uint64(BAND)) | band[doc[take]].astype(np.uint64))
        rows.append(doc[take])
    out, rows = np.concatenate(out), np.concatenate(rows)
    order = np.argsort(rows, kind="stable")
    return out[order], np.bincount(rows, minlength=len(counts)), np.minimum(need, AGREE)


# --- per document ---------------------------------------------------------------------------

SIGNED = "doc_id long, n long, node long, band long, need long, need_next long, signs long, sigs array<long>"


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _each(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[tuple]:
    """Ids, elements and their counts, signatures and their counts, and needs of slices of ``doc_id, text``."""
    bands = Bands(percent)
    for batch in batches:
        for at, data, offsets in slices(batch.column(1)):
            elements, counts = sets(data, offsets, words)
            sigs, n, *needs = needing(elements, counts, bands)
            yield batch.column(0).slice(at, len(counts)), elements, counts, sigs, n, needs


def signed(docs: DataFrame, words: int, percent: int, sign: bool = True) -> DataFrame:
    """Every document's set size, set id, band, needs (see ``needing``), number of signatures and, if asked for, signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, elements, counts, sigs, n, needs in _each(batches, words, percent):
            signs = pa.array(n)
            if not sign:
                sigs, n = sigs[:0], np.zeros(len(counts), np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(sigs.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(counts.astype(np.int64)), pa.array(set_ids(elements, counts)), *map(pa.array, needs), signs, lists],
                names=["doc_id", "n", "node", "band", "need", "need_next", "signs", "sigs"],
            )

    return _texts(docs).mapInArrow(run, SIGNED)


def once_each(docs: DataFrame, made: DataFrame, nodes: DataFrame) -> DataFrame:
    """``docs`` without those whose set another document stands for (``nodes``), as long as so
    many ids (``FETCH``) can be broadcast."""
    copies = keep(made.where("n > 0").select("doc_id").distinct().join(nodes.select("doc_id").distinct(), "doc_id", "left_anti"), "join-copies")
    return docs.join(F.broadcast(copies), "doc_id", "left_anti") if copies.count() <= FETCH else docs


def packed(x: np.ndarray) -> bytes:
    """Ascending numbers of 32 bits as differences of three bytes, or four where one is too large."""
    d = np.diff(x, prepend=x[:0].dtype.type(0)).astype("<u4")
    width = 3 if not len(d) or int(d.max()) < 1 << 24 else 4
    return bytes([width]) + np.ascontiguousarray(d.view(np.uint8).reshape(-1, 4)[:, :width]).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    d = np.frombuffer(raw, np.uint8, offset=1).reshape(-1, raw[0])
    out = np.zeros((len(d), 4), np.uint8)
    out[:, : raw[0]] = d
    return np.cumsum(out.reshape(-1).view("<u4"), dtype=np.uint32)


def met_again(docs: DataFrame, words: int, percent: int, total: int) -> tuple[int, np.ndarray]:
    """How many first bits of a signature a map looks at, and the map: a bit is set where two rows or
    more have the same signature. ``total`` is about the number of signatures of ``docs``.

    A task sends, for each part of the signatures, their first bits in ascending order; a part is
    ``PART`` signatures, and its piece of the map all that the driver gets.
    """
    bits = int(min(MAP_BITS, max(16, total.bit_length() + 1)))
    high = int(min(bits - 3, max(4, (total // PART).bit_length())))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            x = np.sort(np.concatenate(held) >> np.uint64(32 - high))
            ends = np.searchsorted(x >> np.uint64(32), np.arange(1 << high, dtype=np.uint64), "right")
            parts = [packed(p.astype(np.uint32)) for p in np.split(x, ends[:-1])]
            return pa.RecordBatch.from_arrays([pa.array(np.arange(1 << high)), pa.array(parts, pa.binary())], names=["part", "raw"])

        for _, _, _, sigs, _, _ in _each(batches, words, percent):
            held.append(sigs)
            size += len(sigs)
            if size > PART:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    def count(table: pa.Table) -> pa.Table:
        x = np.sort(np.concatenate([unpacked(raw.as_py()) for raw in table["raw"]]))
        piece = np.zeros(1 << (bits - high), bool)
        piece[x[1:][x[1:] == x[:-1]] >> np.uint32(32 - bits + high)] = True
        return pa.table({"part": table["part"][:1], "piece": pa.array([np.packbits(piece).tobytes()], pa.binary())})

    sent = _texts(docs).mapInArrow(send, "part long, raw binary")
    pieces = keep(sent.groupBy("part").applyInArrow(count, "part long, piece binary"), "join-map").toArrow()
    seen = np.zeros((1 << high, 1 << (bits - high - 3)), np.uint8)
    for part, piece in zip(pieces["part"].to_pylist(), pieces["piece"], strict=True):
        seen[part] = np.frombuffer(piece.as_buffer(), np.uint8)
    return bits, seen.reshape(-1)


def shared_signatures(docs: DataFrame, words: int, percent: int, total: int) -> DataFrame:
    """``sig, node``, written to shared storage: signatures of every set but for most that are one row's only."""
    bits, seen = met_again(docs, words, percent, total)
    held = docs.sparkSession.sparkContext.broadcast(seen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, elements, counts, sigs, n, _ in _each(batches, words, percent):
            at = sigs >> np.uint64(64 - bits)
            take = (held.value[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & np.uint8(1) > 0
            node = np.repeat(set_ids(elements, counts), n)[take]
            yield pa.RecordBatch.from_arrays([pa.array(sigs[take].view(np.int64)), pa.array(node)], names=["sig", "node"])

    made = keep(_texts(docs).mapInArrow(run, "sig long, node long"), "join-signatures")
    held.destroy()
    return made


def sketches(elements: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Per set: how many of its elements fall into each of ``SKETCH`` buckets (255 at most).

    Two sets differ in at least as many elements as their sketches' buckets differ in all.
    """
    row = np.repeat(np.arange(len(counts)), counts)
    bucket = ((elements * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(32)).astype(np.int64) % SKETCH
    held = np.bincount(row * SKETCH + bucket, minlength=len(counts) * SKETCH)
    return [x.tobytes() for x in np.minimum(held, 255).astype(np.uint8).reshape(len(counts), SKETCH)]


def fetched(docs: DataFrame, nodes: DataFrame, words: int, value: str = "elements") -> DataFrame:
    """``node, n`` and ``elements`` or ``sketch`` of the wanted nodes, written to shared storage;
    ``nodes`` has ``node`` and one ``doc_id`` of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in slices(batch.column(1)):
                elements, counts = sets(data, offsets, words)
                ends = np.cumsum(counts)
                if value == "sketch":
                    raw = sketches(elements, counts)
                else:
                    raw = [elements[e - c : e].tobytes() for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(set_ids(elements, counts)), pa.array(counts.astype(np.int64)), pa.array(raw, pa.binary())], names=["node", "n", value])

    nodes = keep(nodes.select("node", "doc_id").distinct(), "join-wanted")
    n = nodes.count()
    few = F.broadcast if n <= FETCH else lambda x: x
    some = _texts(docs).join(few(nodes.select("doc_id").distinct()), "doc_id", "left_semi")
    # two texts under one doc_id: keep the wanted sets
    found = keep(some.mapInArrow(run, f"node long, n long, {value} binary").join(few(nodes.select("node")), "node", "left_semi"), "join-sets")
    if found.count() <= n:
        return found
    # rows that repeat a doc_id: each set once
    once = keep(found.dropDuplicates(["node"]), "join-sets")
    discard(found)
    return once


# --- pairs ----------------------------------------------------------------------------------


PAIRS = "kind int, x long, y long, at long"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's sorted ``sig, node`` rows. Kind 0: sets next to each other in a signature, and its
    band; kind 1: rows of signatures with two sets or more, or at an end of the task."""
    held = np.zeros((0, 2), np.int64)  # rows of the last signature, or only its last row if told
    first, told = None, False

    def out(kind: int, x: np.ndarray, y: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int32)), pa.array(x), pa.array(y), pa.array(at)], names=["kind", "x", "y", "at"])

    for batch in batches:
        if not batch.num_rows:
            continue
        sig, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        rows = np.concatenate((held, np.stack((sig, node), 1)))
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (rows[1:] != rows[:-1]).any(1)
        rows = rows[fresh]
        if first is None:
            first = rows[0].copy()
        same = rows[1:, 0] == rows[:-1, 0]
        new = np.flatnonzero(same)
        new = new[new + 1 >= len(held)]
        if len(new):
            yield out(0, rows[new, 1], rows[new + 1, 1], rows[new, 0] & BAND)
        begins = np.flatnonzero(np.concatenate(([True], ~same)))
        sizes = np.diff(np.concatenate((begins, [len(rows)])))
        many = (sizes >= 2) | (rows[begins, 0] == first[0])
        many[0] |= told
        take = np.repeat(many, sizes)
        if told:
            take[: len(held)] = False
        if take.any():
            yield out(1, rows[take, 0], rows[take, 1], rows[take, 0] & BAND)
        told = bool(many[-1])
        held = rows[-1:] if told else rows[begins[-1] :]
    if first is not None and not told:
        yield out(1, held[:, 0].copy(), held[:, 1].copy(), held[:, 0] & BAND)


def neighbours(rows: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From ``sig, node``: pairs ``a < b`` that stand next to each other in so many signatures of a
    band as both need, and the rows of signatures that may have two sets or more. What these
    rows hold besides is for ``crossing`` to find."""
    made = keep(rows.repartitionByRange("sig", "node").sortWithinPartitions("sig", "node").mapInArrow(_walk, PAIRS), "join-walk")
    met = made.where("kind = 0").groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.col("at").alias("in")).count()
    need = needs(nodes)
    for end in "ab":
        met = met.join(need.toDF(end, "in", "__need"), [end, "in"]).where("count >= __need").drop("__need")
    pairs = keep(met.select("a", "b").distinct(), "join-pairs")
    members = keep(made.where("kind = 1").select(F.col("x").alias("sig"), F.col("y").alias("node")), "join-members")
    discard(made)
    return pairs, members


def needs(nodes: DataFrame) -> DataFrame:
    """``node, in, need``: the bands in which a set signs, and how many signatures it needs there."""
    both = F.array(F.struct(F.col("band").alias("in"), "need"), F.struct((F.col("band") + 1).alias("in"), F.col("need_next").alias("need")))
    return nodes.select("node", F.inline(both)).where("need > 0")


def verified(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (distinct ``a, b``) whose sets link, compared element by element."""
    size = nodes.select("node", "n", "doc_id")
    sized = pairs.join(size.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
    sized = keep(sized.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent), "join-sized")
    wanted = size.join(sized.select(F.col("a").alias("node")).union(sized.select("b")).distinct(), "node").select("node", "doc_id")
    got = fetched(docs, wanted, words, "sketch")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, x, y = batch.columns
            both = na.to_numpy() + nb.to_numpy()
            ok = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                p, q = (np.frombuffer(c[i].as_buffer(), np.uint8).astype(np.int16) for c in (x, y))
                ok[i] = int(np.abs(p - q).sum()) * (100 + percent) <= (100 - percent) * both[i]
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(ok)), b.filter(pa.array(ok))], names=["a", "b"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = batch.columns
            ok = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                p, q = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (x, y))
                both = np.concatenate((p, q))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                ok[i] = 100 * common >= percent * (len(p) + len(q) - common)
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(ok)), b.filter(pa.array(ok))], names=["a", "b"])

    def sided(pairs: DataFrame, sets_: DataFrame, value: str) -> DataFrame:
        one = pairs.join(sets_.select(F.col("node").alias("a"), F.col(value).alias("x")), "a")
        return one.join(sets_.select(F.col("node").alias("b"), F.col(value).alias("y")), "b").select(*pairs.columns, "x", "y")

    # sketches, far smaller than sets, rule out most pairs that don't link
    close = keep(sided(sized, got, "sketch").mapInArrow(near, "a long, b long"), "join-close")
    discard(sized, got)
    left = size.join(close.select(F.col("a").alias("node")).union(close.select("b")).distinct(), "node").select("node", "doc_id")
    got = fetched(docs, left, words)
    links = keep(sided(close, got, "elements").mapInArrow(linked, "a long, b long"), "join-links")
    discard(got, close)
    return links


def opened(m: DataFrame) -> DataFrame:
    """``sig, first, pairs`` of signatures (``sig, node, label``) whose sets lie in different components."""
    per = m.groupBy("sig", "label").agg(F.count("*").alias("c"), F.min("node").alias("first")).groupBy("sig").agg(
        F.sum("c").alias("g"), F.sum(F.col("c") * F.col("c")).alias("within"), F.count("*").alias("parts"), F.min("first").alias("first")
    )
    return keep(per.where("parts > 1").select("sig", "first", ((F.col("g") * F.col("g") - F.col("within")) / 2).alias("pairs")), "join-open")


def living(m: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of open signatures, without sets that have fewer of them in a band than they need."""
    open_ = m.groupBy("sig").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("sig")
    rows = keep(m.join(open_, "sig").withColumn("in", F.col("sig").bitwiseAND(F.lit(BAND))), "join-open-rows")
    enough = rows.groupBy("node", "in").count().join(needs(nodes), ["node", "in"]).where("count >= need")
    alive = keep(rows.join(enough.select("node", "in"), ["node", "in"]).select("sig", "node", "label"), "join-living")
    discard(rows, m)
    return alive


def crossing(members: DataFrame, labels: DataFrame, nodes: DataFrame, percent: int, rounds: int = 0) -> tuple[DataFrame, DataFrame]:
    """What neighbours don't settle: signatures whose sets lie in different components.

    Gives pairs to compare, for signatures with up to ``DIRECT`` of them, and for the others
    each set with the signature's least one (``a, b``). With ``rounds``, signatures are those of
    parts: sets with fewer open ones than they need go so many times, and pairs that share fewer.
    """
    m = keep(looked_up(members, labels, "node").select("sig", "node", F.coalesce("label", "node").alias("label")), "join-labelled")
    for _ in range(rounds):
        m = living(m, nodes)
    per = opened(m)
    x = m.join(per, "sig").join(nodes.select("node", "n"), "node").withColumn("in", F.col("sig").bitwiseAND(F.lit(BAND)) if rounds else F.lit(0).cast("long"))
    few, many = F.col("pairs") <= DIRECT, F.col("pairs") > DIRECT
    if rounds:
        hot = x.where(many).groupBy("node", "in").agg(F.count("*").alias("hot"))
        x = x.join(needs(nodes), ["node", "in"]).join(hot, ["node", "in"], "left").withColumn("hot", F.coalesce("hot", F.lit(0)))
    else:
        x = x.withColumns({"need": F.lit(0), "hot": F.lit(0)})
    x_ = keep(x, "join-crossing")
    star = keep(x_.where(many).select(F.col("node").alias("a"), F.col("first").alias("b")), "join-star")
    x = x_.where(few)
    y = x.select("sig", F.col("node").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"), F.col("need").alias("need_b"), F.col("hot").alias("hot_b"))
    close = (F.least("n", "nb") * 100 >= F.greatest("n", "nb") * percent) & (F.col("label") < F.col("lb"))
    met = x.join(y, "sig").where(close).groupBy(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b"), "in")
    met = met.agg(F.count("*").alias("c"), F.max(F.greatest("need", "need_b")).alias("need"), F.max(F.least("hot", "hot_b")).alias("hot"))
    pairs = keep(met.where("c + hot >= need").select("a", "b").distinct(), "join-more")
    discard(m, per, x_)
    return pairs, star


def rarest(docs: DataFrame, hot: DataFrame, words: int, percent: int) -> DataFrame:
    """``sig, node`` of the sets ``hot`` (``node, doc_id``): their first elements, rarest ones first.

    Rarity is counted in ``BUCKETS`` buckets: a vector a task, one sum a bucket, and a broadcast
    of that size whatever the input.
    """
    sets_ = fetched(docs, hot, words)

    def bucket(elements: np.ndarray) -> np.ndarray:
        return (mix(elements) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                total += np.bincount(bucket(np.frombuffer(raw.as_buffer(), np.uint64)), minlength=BUCKETS) if len(raw.as_buffer()) > BUCKETS else 0
            small = [np.frombuffer(raw.as_buffer(), np.uint64) for raw in batch.column(0) if len(raw.as_buffer()) <= BUCKETS]
            if small:
                total += np.bincount(bucket(np.concatenate(small)), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    spark = docs.sparkSession
    sums = sets_.select("elements").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    held = np.zeros(BUCKETS, np.int64)
    held[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    ranks = spark.sparkContext.broadcast(held)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, rows = [], []
            for node, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(raw.as_buffer(), np.uint64)
                n = len(own) - -(-percent * len(own) // 100) + 1
                out.append(own[np.lexsort((own, ranks.value[bucket(own)]))[:n]])
                rows.append(np.full(len(out[-1]), node, np.int64))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.concatenate(rows))], names=["sig", "node"])

    made = keep(sets_.select("node", "elements").mapInArrow(first, "sig long, node long"), "join-rarest")
    discard(sets_)
    return made


def clustered(star: DataFrame, labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, label, n, doc_id, cluster`` of what common signatures connect."""
    cluster = components.label(star)
    rows = cluster.select("node", F.col("label").alias("cluster")).join(labels, "node", "left").join(nodes.select("node", "n", "doc_id"), "node")
    return keep(rows.select("node", F.coalesce("label", "node").alias("label"), "n", "doc_id", "cluster"), "join-clustered")


PAIR = ["cluster", "b1", "j1", "b2", "j2"]


def blockwise(docs: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Links across components inside each cluster (``cluster, node, label, n, doc_id``), block of
    sets against block of sets.

    A block holds about ``BLOCK_SETS`` sets or ``BLOCK_ELEMENTS`` elements of one size class; only neighbouring classes can
    link. A task sees two blocks and gives only so many of their links as connect the same sets:
    no more rows than it reads, however many of its pairs link.
    """
    spark = docs.sparkSession
    if rows.isEmpty():
        return spark.createDataFrame([], "a long, b long")
    step = np.log(100 / percent)
    rows = rows.withColumn("b", F.floor(F.log(F.col("n")) / F.lit(float(step)) + 1e-9))
    blocks = F.greatest(F.ceil(F.count("*") / F.lit(BLOCK_SETS)), F.ceil(F.sum("n") / F.lit(BLOCK_ELEMENTS)))
    counts = rows.groupBy("cluster", "b").agg(blocks.alias("blocks"))
    rows = rows.join(counts, ["cluster", "b"]).withColumn("j", F.pmod(F.xxhash64("node"), F.col("blocks")))
    each = counts.select("cluster", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("j"))
    one, two = each.toDF("cluster", "b1", "j1"), each.toDF("cluster", "b2", "j2")
    near = (F.col("b2") - F.col("b1")).isin(0, 1) & ((F.col("b1") < F.col("b2")) | (F.col("j1") <= F.col("j2")))
    pairs = keep(one.join(two, "cluster").where(near), "join-blocks")
    got = fetched(docs, rows.select("node", "doc_id"), words).select("node", "elements")
    rows = keep(rows.join(got, "node").select("cluster", "b", "j", "node", "label", "elements"), "join-block-rows")
    left = pairs.join(rows.withColumnsRenamed({"b": "b1", "j": "j1"}), ["cluster", "b1", "j1"]).withColumn("side", F.lit(0))
    right = pairs.where("b1 <> b2 or j1 <> j2").join(rows.withColumnsRenamed({"b": "b2", "j": "j2"}), ["cluster", "b2", "j2"]).withColumn("side", F.lit(1))
    both = left.select(*PAIR, "side", "node", "label", "elements").unionByName(right.select(*PAIR, "side", "node", "label", "elements"))

    def compare(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        node, label = table["node"].to_numpy(), table["label"].to_numpy()
        sets_ = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["elements"].combine_chunks()]
        x = np.flatnonzero(side == 0)
        y = np.flatnonzero(side == 1)
        if all(table[f"{c}1"][0] == table[f"{c}2"][0] for c in "bj"):  # a block with itself
            y = x
        if not len(x) or not len(y):
            return pa.table({"a": node[:0], "b": node[:0]})
        n = np.array([len(s) for s in sets_])
        found = []
        for at in range(0, len(x), BLOCK_ROWS):
            some = x[at : at + BLOCK_ROWS]
            common = _common([sets_[i] for i in some], [sets_[i] for i in y])
            linked = (100 * common >= percent * (n[some][:, None] + n[y][None, :] - common)) & (label[some][:, None] != label[y][None, :])
            found.append(np.packbits(linked, axis=1))  # an eighth, until all rows are there
        a, b = forest(np.concatenate(found), x, y)
        a, b = node[a], node[b]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    links = keep(both.groupBy(*PAIR).applyInArrow(compare, "a long, b long"), "join-links")
    discard(rows)
    return links


def forest(linked: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links between ``x`` and ``y`` (rows of bits), so many as connect the same: one fewer than
    sets at most. ``y`` is ``x`` itself or has none of it."""
    by_row, ends = linked, []
    by_column = by_row if y is x else np.packbits(np.unpackbits(linked, axis=1, count=len(y)).T, axis=1)
    fresh_x = np.ones(len(x), bool)
    fresh_y = fresh_x if y is x else np.ones(len(y), bool)
    sides = ((by_row, fresh_y, len(y)), (by_column, fresh_x, len(x)))
    for first in range(len(x)):
        if not fresh_x[first]:
            continue
        fresh_x[first] = False
        todo = [(0, first)]
        while todo:
            side, i = todo.pop()
            rows, fresh, n = sides[side]
            met = np.flatnonzero(np.unpackbits(rows[i], count=n).view(bool) & fresh)
            fresh[met] = False
            ends += [(i, j) if side == 0 else (j, i) for j in met.tolist()]
            todo += [(1 - side, j) for j in met.tolist()]
    i, j = np.array(ends, np.int64).reshape(-1, 2).T
    return x[i], y[j]


def _common(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by counting over the elements that both sides have."""
    nx, ny = [len(s) for s in xs], [len(s) for s in ys]
    x, y = np.concatenate(xs), np.concatenate(ys)
    shared = np.intersect1d(x, y)
    out = np.zeros(len(xs) * len(ys), np.int64)

    def held(elements: np.ndarray, n: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows by shared element, where each element's begin, and how many it has."""
        at = np.minimum(np.searchsorted(shared, elements), max(len(shared) - 1, 0))
        ok = np.flatnonzero(shared[at] == elements) if len(shared) else np.zeros(0, np.int64)
        order = ok[np.argsort(at[ok], kind="stable")]
        count = np.bincount(at[ok], minlength=len(shared))
        return np.repeat(np.arange(len(n)), n)[order], np.cumsum(count) - count, count

    rx, bx, cx = held(x, nx)
    ry, by, cy = held(y, ny)
    many = cx * cy > DENSE
    few = np.flatnonzero(~many)
    steps = np.searchsorted(np.cumsum((cx * cy)[few]), np.arange(1 << 22, int((cx * cy)[few].sum()) + (1 << 22), 1 << 22))
    for e in np.split(few, np.unique(steps)):
        if len(e):
            i = np.repeat(_places(bx[e], cx[e]), np.repeat(cy[e], cx[e]))
            j = _places(np.repeat(by[e], cx[e]), np.repeat(cy[e], cx[e]))
            out += np.bincount(rx[i] * len(ys) + ry[j], minlength=len(out))
    out = out.reshape(len(xs), len(ys))
    dense = np.flatnonzero(many)
    for at in range(0, len(dense), 1024):
        e = dense[at : at + 1024]
        mx, my = np.zeros((len(xs), len(e)), np.float32), np.zeros((len(ys), len(e)), np.float32)
        mx[rx[_places(bx[e], cx[e])], np.repeat(np.arange(len(e)), cx[e])] = 1
        my[ry[_places(by[e], cy[e])], np.repeat(np.arange(len(e)), cy[e])] = 1
        out += (mx @ my.T).astype(np.int64)
    return out


def _places(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All integers of the stretches, one after the other."""
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def link(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document, written to shared storage."""
    docs = docs.select("doc_id", "text")
    with scratch() as spare:
        # signatures are far larger than texts' sizes and ids: they are made again instead of being stored
        made = keep(signed(docs, words, percent, False).drop("sigs"), "join-signed")
        nodes = keep(made.where("n > 0").groupBy("node", "n").agg(F.min("doc_id").alias("doc_id"), *[F.max(c).alias(c) for c in ("band", "need", "need_next")]), "join-nodes")
        rows = shared_signatures(once_each(docs, made, nodes), words, percent, made.agg(F.sum("signs")).first()[0] or 0)
        pairs, members = neighbours(rows, nodes)
        discard(rows)
        links = verified(docs, pairs, nodes, words, percent)
        labels = components.label(links)
        more, star = crossing(members, labels, nodes, percent, ROUNDS)
        discard(members)
        if not star.isEmpty():
            hot = star.select(F.col("a").alias("node")).distinct().join(nodes.select("node", "doc_id"), "node")
            first = rarest(docs, hot, words, percent)
            again, star = crossing(first, labels, nodes, percent)
            discard(first)
            more = more.union(again).distinct()
        links = links.union(verified(docs, more.join(pairs, ["a", "b"], "left_anti"), nodes, words, percent))
        links = links.union(blockwise(docs, clustered(star, labels, nodes), words, percent))
        return spare(keep(numbered(docs, made, nodes, links, words, percent), "join-linked"))


def numbered(docs: DataFrame, made: DataFrame, nodes: DataFrame, links: DataFrame, words: int, percent: int) -> DataFrame:
    """Each document's component as the least doc_id in it: sets stand for their least doc_id,
    so a component's label is its number already."""
    by = nodes.select("node", "doc_id")
    ends = links.join(by.toDF("a", "x"), "a").join(by.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    label = components.label(ends).toDF("doc_id", "label")
    of_node = keep(by.join(label, "doc_id", "left").select("node", F.coalesce("label", "doc_id").alias("component_id")), "join-of-node")
    some = looked_up(made.where("n > 0").select("doc_id", "n", "node"), of_node, "node")
    none = made.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    both = some.select("doc_id", "n", "component_id").unionByName(none)
    return both.withColumnRenamed("n", "n_shingles").unionByName(_without_id(docs, words, percent))


def _without_id(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Rows without doc_id: their set size, and no component."""
    null = F.lit(None).cast("long")
    lone = docs.where("doc_id is null").select(F.lit(0).cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return signed(lone, words, percent, False).select(null.alias("doc_id"), F.col("n").alias("n_shingles"), null.alias("component_id"))


def keep_first(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component, the one of least doc_id. Of rows that repeat a
    doc_id one stays. Documents without words stay, and all without an id; all columns stay,
    whatever their names."""
    found = link(docs, words, percent).where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("rows"))
    found = keep(found.where("doc_id <> component_id or rows > 1").select(F.col("doc_id").alias("__id"), (F.col("doc_id") == F.col("component_id")).alias("__stays")), "join-drop")
    ids = F.broadcast(found) if found.count() <= FETCH else found
    out = docs.join(ids, docs["doc_id"] == ids["__id"], "left_anti")
    again = found.where("__stays")
    if again.isEmpty():
        return out
    return out.unionByName(docs.join(again, docs["doc_id"] == again["__id"], "left_semi").dropDuplicates(["doc_id"]))
