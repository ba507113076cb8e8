"""Token counts and token ids by a public tokenizer, in Arrow functions.

Texts are read as bytes in windows of about ``WINDOW_BYTES``, so that work is dealt by bytes
however long the texts are. A window ends at a safe boundary: right before a space or newline
that follows anything but white space. A byte-level BPE never joins what such a cut parts, and
no added token holds white space, so the ids of the pieces between all safe boundaries, put
together, are the ids of the whole text. Pieces repeat a lot: those of up to ``SHORT`` bytes
are known by a 64-bit hash, encoded once and remembered (``MEMO_BYTES`` a worker at most).
Unseen pieces that may stand behind each other go to the library joined to texts of ``JOIN``
bytes, since a call for each would cost more than its encoding; the bytes that an id stands for
say which piece it is of. Others go one by one, in calls of at most ``CALL_BYTES`` bytes. Only
counts leave the counting function, never ids or texts.

Defined cases: a null text is an empty one (0 bytes, 0 tokens); text without safe boundary is
one piece, however long; other columns, whatever their names, and repeated rows change nothing.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shingles import piece_hashes, slices

FILE = "byte_bpe_50k.json"
LIMIT = 1024
WINDOW_BYTES = 1 << 20
SHORT = 64
MEMO_BYTES = 96 << 20
CALL_BYTES = 1 << 20
JOIN = 8 << 10

#: Tokenizers whose pieces split before a space; for the others the whole text is a piece.
_SPLITS = {"byte_bpe_50k.json"}
_loaded: dict[str, Encoder] = {}
_BREAK = np.zeros(256, bool)
_BREAK[[10, 32]] = True
#: White space of one byte, as the tokenizers' expressions and Unicode have it.
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: Last bytes of white space of two bytes (after C2), and of three after E2 80.
_WHITE_2 = np.zeros(256, bool)
_WHITE_2[[0x85, 0xA0]] = True
_WHITE_3 = np.zeros(256, bool)
_WHITE_3[[*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF]] = True


def path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _after_white(data: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Whether the character before each place (1 or more) is white space, or might be."""
    one, two, three = data[p - 1], data[np.maximum(p - 2, 0)], data[np.maximum(p - 3, 0)]
    white = _WHITE[one]
    far = np.flatnonzero(one >= 0x80)
    one, two, three = one[far], two[far], three[far]
    white[far] = ((two == 0xC2) & _WHITE_2[one]) | ((three == 0xE2) & (two == 0x80) & _WHITE_3[one]) | ((three == 0xE1) & (two == 0x9A) & (one == 0x80)) | ((three == 0xE2) & (two == 0x81) & (one == 0x9F)) | ((three == 0xE3) & (two == 0x80) & (one == 0x80))
    return white


def boundaries(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces start: each text that isn't empty, and each safe boundary inside one."""
    start = _BREAK[data]
    start[:1] = False
    p = np.flatnonzero(start)
    start[p[_after_white(data, p)]] = False
    start[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(start)


def _library(name: str):
    """``encode(list of str) -> list of id lists`` of the library for the file ``name``, and the size of its vocabulary."""
    if name.endswith(".json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path(name))
        tok.no_truncation()
        tok.no_padding()
        return (lambda xs: [e.ids for e in tok.encode_batch_fast(xs, add_special_tokens=False)]), tok.get_vocab_size()
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path(name))
    return (lambda xs: model.encode(xs, num_threads=1)), model.get_piece_size()


def _lengths(name: str) -> np.ndarray:
    """How many bytes each id of a byte-level vocabulary stands for."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path(name))
    out = np.zeros(tok.get_vocab_size(), np.int64)
    added = tok.get_added_tokens_decoder()
    for word, i in tok.get_vocab().items():
        # one character a byte, but for added tokens, which are what they say
        out[i] = len(word.encode()) if i in added else len(word)
    return out


def _stretches(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All places of the stretches, one after the other."""
    n = ends - starts
    return np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Encoder:
    """Ids of texts given as bytes and offsets; remembers short pieces."""

    def __init__(self, name: str):
        self.encode, vocabulary = _library(name)
        self.splits = name in _SPLITS
        self.bytes_of = _lengths(name) if self.splits else None
        #: Ids as they are stored: two bytes each where they fit.
        self.dtype = np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")
        self.place: dict[int, int] = {}
        self.pool, self.begin, self.count = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.pieces, self.used = 0, 0

    def _one_by_one(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces end to end, and how many each has, in calls by bytes."""
        flat, n, at = [], [], 0
        while at < len(starts):
            to = at + max(1, int(np.searchsorted(np.cumsum(ends[at:] - starts[at:]), CALL_BYTES, "right")))
            for ids in self.encode([data[s:e].tobytes().decode() for s, e in zip(starts[at:to].tolist(), ends[at:to].tolist(), strict=True)]):
                flat.append(np.array(ids, np.uint32))
                n.append(len(ids))
            at = to
        return np.concatenate(flat) if flat else np.zeros(0, np.uint32), np.array(n, np.int64)

    def _joined(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces that may stand behind each other."""
        both = data[_stretches(starts, ends)]
        at = np.concatenate(([0], np.cumsum(ends - starts)))
        texts = np.unique(np.searchsorted(at, np.arange(0, at[-1], JOIN)))
        where = np.append(at[texts], at[-1])
        flat, _ = self._one_by_one(both, where[:-1], where[1:])
        begin = np.cumsum(self.bytes_of[flat]) - self.bytes_of[flat]
        return flat, np.diff(np.searchsorted(begin, at))

    def _add(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Put the pieces' ids into the pool; their places there."""
        joint = _BREAK[data[starts]] & ~_after_white(data, ends) if self.splits else np.zeros(len(starts), bool)
        out = np.empty(len(starts), np.int64)
        for some, look in ((joint, self._joined), (~joint, self._one_by_one)):
            if some.any():
                flat, n = look(data, starts[some], ends[some])
                while self.used + len(flat) > len(self.pool):
                    self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
                while self.pieces + len(n) > len(self.begin):
                    self.begin, self.count = (np.concatenate((x, np.zeros_like(x))) for x in (self.begin, self.count))
                self.pool[self.used : self.used + len(flat)] = flat
                self.begin[self.pieces : self.pieces + len(n)] = self.used + np.cumsum(n) - n
                self.count[self.pieces : self.pieces + len(n)] = n
                out[some] = self.pieces + np.arange(len(n))
                self.pieces, self.used = self.pieces + len(n), self.used + len(flat)
        return out

    def windows(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(starts of pieces, their places in the pool)``, window by window, in order.

        What is in the pool counts until the next window; then long pieces, and short ones
        beyond ``MEMO_BYTES``, make room for others.
        """
        starts = boundaries(data, offsets) if self.splits else offsets[:-1][np.diff(offsets) > 0]
        ends = np.append(starts[1:], len(data))
        at = 0
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + WINDOW_BYTES, "right")))
            s, e = starts[at:to], ends[at:to]
            where = np.empty(to - at, np.int64)
            short = (e - s <= SHORT) if self.splits else np.zeros(to - at, bool)
            code, names = pd.factorize(piece_hashes(data, s[short], e[short]))
            held = np.fromiter((self.place.get(x, -1) for x in names.tolist()), np.int64, len(names))
            new = np.flatnonzero(held < 0)
            if len(new):
                first = np.empty(len(names), np.int64)
                first[code[::-1]] = np.flatnonzero(short)[::-1]
                held[new] = self._add(data, s[first[new]], e[first[new]])
            if self.pieces * 160 + self.used * 4 > MEMO_BYTES:
                kept = (self.pieces, self.used) if not len(new) else (int(held[new].min()), int(self.begin[held[new]].min()))
            else:
                self.place.update(zip(names[new].tolist(), held[new].tolist(), strict=True))
                kept = self.pieces, self.used
            where[short] = held[code]
            if not short.all():
                where[~short] = self._add(data, s[~short], e[~short])
            yield s, where
            # what isn't remembered leaves the pool
            self.pieces, self.used = kept
            at = to

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.zeros(len(offsets) - 1, np.int64)
        for starts, where in self.windows(data, offsets):
            row = np.searchsorted(offsets, starts, "right") - 1
            first = int(row[0])
            n = np.bincount(row - first, self.count[where])
            out[first : first + len(n)] += n.astype(np.int64)
        return out

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts' ids end to end, and how many each has."""
        flat, out = [], np.zeros(len(offsets) - 1, np.int64)
        for starts, where in self.windows(data, offsets):
            row = np.searchsorted(offsets, starts, "right") - 1
            first, n = int(row[0]), self.count[where]
            per = np.bincount(row - first, n)
            out[first : first + len(per)] += per.astype(np.int64)
            flat.append(self.pool[_stretches(self.begin[where], self.begin[where] + n)])
        return np.concatenate(flat) if flat else np.zeros(0, np.uint32), out


def encoder(name: str = FILE) -> Encoder:
    """The worker's encoder, loaded once."""
    if name not in _loaded:
        _loaded[name] = Encoder(name)
    return _loaded[name]


def n_tokens(text: Column, name: str = FILE) -> Column:
    """Number of tokens of ``text`` as an Arrow function of lengths."""

    @F.arrow_udf("long")
    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = encoder(name).counts
        for batch in batches:
            found = [count(data, offsets) for _, data, offsets in slices(batch, 8 * WINDOW_BYTES)]
            yield pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))

    return lengths(F.coalesce(text, F.lit("")))


def count_tokens(docs: DataFrame, name: str = FILE, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), n_tokens(F.col("text"), name).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
