"""Packing documents into training sequences along a space-filling curve.

A document's token ids (and a closing id 0) are cut into pieces. Every full ``WINDOW`` ids
are a sequence of their own; what is left of a document, its tail, is packed with its
neighbours. A tail's place is the Hilbert key of its document: signed hashed counts of its
ids, projected on ``DIMS`` fixed random directions, each coordinate in ``BITS`` bits. Tails
are range-sorted by (key, id), so equal keys spread over tasks, and laid end to end; each
task cuts its run every ``WINDOW`` ids. The last ids of a run become sequences of powers of
two, which need no padding.

Texts are encoded once: what the cut needs (tails' ids, two bytes each where they fit) goes
to shared storage before the sort, so neither the sampling of ranges nor a lost executor
encodes again.

Defined cases: a null text is an empty one, whose only id is the closing one; a text of any
length is cut whole; equal rows are packed each for itself; an empty table gives no piece;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep
from .shingles import slices
from .tokens import FILE, encoder

WINDOW = 1024
CLOSE = 0
DIMS, BITS = 3, 16
HASHED = 64
SEED = 7
#: Bytes of text encoded at once.
SLICE = 1 << 20

CUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, place long, width int, ids binary"
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def crcs(ids: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Checksum of each stretch of ``ids`` as little-endian unsigned 32-bit integers."""
    raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    return np.fromiter((zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)), np.int64, len(begins))


def directions() -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((HASHED, DIMS))


def _slots(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(58)).astype(np.int64) % HASHED, 1.0 - 2.0 * ((mixed >> np.uint64(33)) & np.uint64(1)).astype(np.float64)


_SLOT, _SIGN = _slots(np.arange(1 << 16))


def vectors(ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One unit vector of hashed counts a document, from the documents' ids end to end."""
    slot, sign = (_SLOT[ids], _SIGN[ids]) if not len(ids) or ids.max() < len(_SLOT) else _slots(ids)
    out = np.bincount(np.repeat(np.arange(len(n)) * HASHED, n) + slot, sign, len(n) * HASHED).reshape(len(n), HASHED)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def hilbert(points: np.ndarray) -> np.ndarray:
    """Key along the Hilbert curve of points in the unit cube, by the transpose method.

    One Gray-code bit of every axis at a time, from the highest: the axes below are mirrored
    or swapped with the first as the bits above demand; then the bits interleave.
    """
    x = [(np.clip(points[:, i], 0, 1 - 1e-9) * (1 << BITS)).astype(np.int64) for i in range(DIMS)]
    bit = 1 << (BITS - 1)
    while bit > 1:
        low = bit - 1
        for i in range(DIMS):
            up = (x[i] & bit) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        bit >>= 1
    for i in range(1, DIMS):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    bit = 1 << (BITS - 1)
    while bit > 1:
        turn = np.where((x[-1] & bit) != 0, turn ^ (bit - 1), turn)
        bit >>= 1
    key = np.zeros_like(x[0])
    for b in range(BITS - 1, -1, -1):
        for i in range(DIMS):
            key = (key << 1) | (((x[i] ^ turn) >> b) & 1)
    return key


def places(ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    flat = vectors(ids, n) @ directions()
    return hilbert(1 / (1 + np.exp(-1.7 * flat)))


def _closed(ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same with the closing id after each document."""
    out = np.empty(len(ids) + len(n), np.uint32)
    own = np.ones(len(out), bool)
    own[np.cumsum(n + 1) - 1] = False
    out[own], out[~own] = ids, CLOSE
    return out, n + 1


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=[x.split()[0] for x in schema.split(", ")])


def cut(docs: DataFrame, name: str = FILE, window: int = WINDOW) -> DataFrame:
    """Full pieces (without ids) and tails (with theirs) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name)
        for batch in batches:
            for at, data, offsets in slices(batch.column(1), SLICE):
                ids, n = _closed(*enc.ids(data, offsets))
                doc_id, place = batch.column(0).slice(at, len(n)), places(ids, n)
                ends = np.cumsum(n)
                parts = -(-n // window)
                doc = np.repeat(np.arange(len(n)), parts)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * window
                begin = (ends - n)[doc] + start
                end = np.minimum(begin + window, ends[doc])
                long, sums = end - begin, crcs(ids, begin, end)
                for some in (long == window, long < window):
                    d = doc[some]
                    if not len(d):
                        continue
                    tail = long[some][0] < window
                    width = np.full(len(d), enc.dtype.itemsize if tail else 0, np.int32)
                    yield _batch(CUT, [doc_id.take(pa.array(d)), start[some], long[some], sums[some], n[d], place[d], width, _tails(ids, begin[some], end[some], enc.dtype) if tail else pa.nulls(len(d), pa.binary())])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, CUT)


def _tails(ids: np.ndarray, begin: np.ndarray, end: np.ndarray, dtype: np.dtype) -> pa.Array:
    n = end - begin
    flat = ids[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))].astype(dtype)
    where = np.concatenate(([0], np.cumsum(n) * dtype.itemsize)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(where), pa.py_buffer(flat)])


class _Run:
    """Tails laid end to end: ``doc_id, start, doc_tokens, length`` a tail, and all ids."""

    def __init__(self, doc_id: pa.Array, start: np.ndarray, doc_tokens: np.ndarray, length: np.ndarray, ids: np.ndarray):
        self.doc_id, self.start, self.doc_tokens, self.length, self.ids = doc_id, start, doc_tokens, length, ids

    def then(self, other: _Run) -> _Run:
        both = lambda name: np.concatenate((getattr(self, name), getattr(other, name)))
        return _Run(pa.concat_arrays([self.doc_id, other.doc_id]), both("start"), both("doc_tokens"), both("length"), both("ids"))

    def after(self, at: int) -> _Run:
        """What is left from the ``at``-th id on."""
        ends = np.cumsum(self.length)
        first = int(np.searchsorted(ends, at, "right"))
        gone = max(0, at - int((ends - self.length)[first])) if first < len(ends) else 0
        start, length = self.start[first:].copy(), self.length[first:].copy()
        start[:1] += gone
        length[:1] -= gone
        return _Run(self.doc_id.slice(first), start, self.doc_tokens[first:], length, self.ids[at:])

    def pieces(self, sizes: np.ndarray, first: int) -> pa.RecordBatch:
        """The pieces of sequences of ``sizes`` ids from the beginning on, numbered from ``first``."""
        ends = np.cumsum(sizes)
        stop = int(ends[-1])
        begins = np.cumsum(self.length) - self.length
        at = np.union1d(begins[begins < stop], ends - sizes)
        long = np.append(at[1:], stop) - at
        row, seq = np.searchsorted(begins, at, "right") - 1, np.searchsorted(ends, at, "right")
        sums = crcs(self.ids, at, at + long)
        own = [self.doc_id.take(pa.array(row)), self.start[row] + at - begins[row], long, sums, self.doc_tokens[row]]
        return _batch(PIECE, [*own, 2 * (first + seq) + 1, at - (ends - sizes)[seq]])


def pack_tails(tails: DataFrame, window: int = WINDOW) -> DataFrame:
    """Lay range-sorted tails end to end in every task and cut them into sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held = TaskContext.get().partitionId() << 34, None
        for batch in batches:
            if not batch.num_rows:
                continue
            doc_id, start, doc_tokens, width, raw = batch.columns
            where = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + batch.num_rows + 1]
            dtype = np.dtype(f"<u{width[0].as_py()}")
            ids = np.frombuffer(raw.buffers()[2], np.uint8)[where[0] : where[-1]].view(dtype).astype(np.uint32)
            new = _Run(doc_id, start.to_numpy(), doc_tokens.to_numpy(), np.diff(where).astype(np.int64) // dtype.itemsize, ids)
            held = held.then(new) if held else new
            full = len(held.ids) // window
            if full:
                yield held.pieces(np.full(full, window), made)
                made, held = made + full, held.after(full * window)
        if held and len(held.ids):
            sizes = [1 << b for b in range(window.bit_length(), -1, -1) if len(held.ids) >> b & 1]
            yield held.pieces(np.array(sizes), made)

    return tails.select("doc_id", "start", "doc_tokens", "width", "ids").mapInArrow(run, PIECE)


def pack(docs: DataFrame, name: str = FILE, window: int = WINDOW) -> DataFrame:
    """Every piece of every document with its sequence and place there."""
    made = keep(cut(docs, name, window), "pack-cut")
    full = made.where("ids is null").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.monotonically_increasing_id() * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    tails = made.where("ids is not null").select("doc_id", "start", "doc_tokens", "place", "width", "ids")
    tails = tails.repartitionByRange("place", "doc_id", "start").sortWithinPartitions("place", "doc_id", "start", "doc_tokens")
    return full.unionByName(pack_tails(tails, window))
