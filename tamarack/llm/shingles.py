"""Word-shingle sets of whole texts as 64-bit hashes, computed over Arrow buffers.

Words are runs of anything but the six ASCII white-space characters, A-Z lower-cased. A set
holds the distinct shingles of ``size`` words; a text with fewer words has one shingle, its
whole sequence; a text without words has none. Hashes are polynomial over random byte codes,
then mixed; two different shingles agree with probability 2**-64. Bytes are hashed in chunks of
``CHUNK``, however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = CHUNK = 256 << 10
_RANDOM = np.random.default_rng(20)
_CODES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_PLAIN = _CODES.copy()
for _c in range(65, 91):
    _CODES[_c] = _CODES[_c + 32]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def _powers(base: np.uint64) -> np.ndarray:
    out = np.full(CHUNK + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, out=out)


#: Powers for one chunk, made once a worker.
_POWER, _BACK = _powers(_P), _powers(_P_INV)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, offsets)`` of runs of rows of about ``most`` bytes; no nulls."""
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


#: For search terms, every ASCII character but letters and digits parts words.
SEARCH_SPACE = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def piece_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray | None = None) -> np.ndarray:
    """Hashes of ordered stretches of ``data`` that don't overlap, chunk by chunk."""
    codes = _PLAIN if codes is None else codes
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = int(np.searchsorted(ends, base + CHUNK, "right"))
        if to <= at:  # a stretch longer than a chunk
            total = 0
            for k in range(base, int(ends[at]), CHUNK):
                part = codes[data[k : min(k + CHUNK, int(ends[at]))]]
                total += int((part * _POWER[: len(part)]).sum(dtype=np.uint64)) * pow(int(_P), k - base, 1 << 64)
            out[at] = total % (1 << 64)
            at += 1
            continue
        s, e = starts[at:to] - base, ends[at:to] - base
        total = np.zeros(int(e[-1]) + 1, np.uint64)
        np.multiply(codes[data[base : base + int(e[-1])]], _POWER[: int(e[-1])], out=total[1:])
        np.cumsum(total, out=total)
        out[at:to] = (total[e] - total[s]) * _BACK[s]
        at = to
    return mix(out)


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = ~space[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    begins = offsets[:-1][offsets[:-1] < n]
    first[begins] = word[begins]
    start = np.flatnonzero(first)
    first[:-1] = word[:-1] & (first[1:] | ~word[1:])
    first[-1] = word[-1]
    return piece_hashes(data, start, np.flatnonzero(first) + 1, _CODES), np.searchsorted(offsets, start, "right") - 1


def sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows' sets end to end, each sorted, and the number of elements of every row."""
    rows = len(offsets) - 1
    w, row = words(data, offsets)
    n = np.bincount(row, minlength=rows)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    at = np.concatenate(([0], np.cumsum(n)))
    if len(w) >= size:
        long = w[: len(w) - size + 1] * _PLACE[0]
        for k in range(1, size):
            long = long + w[k : len(w) - size + 1 + k] * _PLACE[k]
        ok = row[: len(w) - size + 1] == row[size - 1 :]
        long = mix(long[ok])
    else:
        long = np.zeros(0, np.uint64)
    to = np.concatenate(([0], np.cumsum(count)))
    out = np.empty(int(to[-1]), np.uint64)
    short = np.flatnonzero((n > 0) & (n < size))
    is_long = np.ones(len(out), bool)
    is_long[to[short]] = False
    out[is_long] = long
    for r in short:
        own = w[at[r] : at[r + 1]]
        out[to[r]] = mix((own * _PLACE[8 : 8 + len(own)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(own)))[0]
    for a, b in zip(to[:-1].tolist(), to[1:].tolist(), strict=True):
        if b - a > 1:
            out[a:b].sort()
    which = np.repeat(np.arange(rows), count)
    fresh = np.ones(len(out), bool)
    fresh[1:] = (out[1:] != out[:-1]) | (which[1:] != which[:-1])
    return out[fresh], np.bincount(which[fresh], minlength=rows)


def set_ids(elements: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One 64-bit id a set, the same for equal sets; rows without elements get 0."""
    ends = np.cumsum(counts)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(elements ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)))
    ids = mix(total[ends] - total[ends - counts] + counts.astype(np.uint64) * _P)
    return np.where(counts > 0, ids, np.uint64(0)).view(np.int64)
