"""Importance resampling towards a target distribution, through a dictionary of distinct features.

Features are all runs of one and of two consecutive words. Texts are read in blocks of about
``BLOCK_BYTES``; a block names each of its features once. Blocks send their distinct strings
and counts to parts by a hash of the words, packed (sorted, joined, compressed), so a string
occurs once a block however often it stands there. A part adds up each string over all blocks,
hashes each distinct string once (CRC-32) and sums the strings' counts by bucket, for corpus
and target alike. Its dictionary rows go back to the blocks as buckets, in the blocks' order;
there they are joined, as gains, to the documents' features.

The number of parts grows with the texts' bytes (one a ``PART_BYTES``), so that what a part or
a block holds does not depend on the input's size: a word that stands in every document is one
entry a block. Only ``BUCKETS`` sums and counts of documents by score come to the driver;
scores are whole numbers of a bounded range, and as the noise is a Gumbel variable of scale
``SCALE``, no score has more than about one document in ``e * SCALE``.

Defined cases: a null or wordless text has no feature and weight 0; without target texts, or
without documents, missing counts are zero; repeated rows count each; a null doc_id draws as
an empty one and comes last among ties; a text of any length is read whole, in pieces; an
empty table gives an empty result; other columns are ignored, or kept by ``draw`` whatever
their names.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import discard, forget, keep, packed, unpacked

BUCKETS = 10_000
SCALE = 1000
SEED = "7"
MIN_WORDS = 20
PERCENT = 25
BLOCK_BYTES = 16 << 20
PART_BYTES = 12 << 20
#: Pairs go to parts by their first word and so many bytes of the second: neighbours in order
#: stay together, which packs well, and pairs of a frequent first word still spread.
HEAD = 2
#: Of zstd, for what is shuffled.
LEVEL = 6
#: Words are cut from so many bytes of a text at once.
PIECE = 1 << 20
_SPACES = bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80))
#: A-Z to a-z, other ASCII signs to spaces.
FOLD = bytes(x + 32 if 0x41 <= x <= 0x5A else 0x20 if x in _SPACES else x for x in range(256))


# --- a block ------------------------------------------------------------------------------


def words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, ``PIECE`` bytes or a little more at a time."""
    at = 0
    while at < len(text):
        piece = text[at : at + PIECE].translate(FOLD)
        at += len(piece)
        while at < len(text) and piece[-1] != 0x20:  # up to the end of the word
            more = text[at : at + 256].translate(FOLD)
            cut = more.find(b" ")
            more = more if cut < 0 else more[: cut + 1]
            piece, at = piece + more, at + len(more)
        yield piece.split()


def spread(first: np.ndarray, second: np.ndarray | int) -> np.ndarray:
    """Even hashes of pairs of hashes."""
    mixed = first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(second, np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(17)


def pairs(ids: np.ndarray, sizes: np.ndarray, n_words: int) -> np.ndarray:
    """Codes of neighbouring words inside documents of so many words."""
    if len(ids) < 2:
        return np.empty(0, np.int64)
    inside = np.ones(len(ids), bool)
    ends = np.cumsum(sizes)
    inside[ends[(ends > 0) & (ends <= len(ids))] - 1] = False
    at = np.flatnonzero(inside)
    return ids[at].astype(np.int64) * n_words + ids[at + 1]


def placed(hashes: np.ndarray, heads: np.ndarray, distinct: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Part of each feature of a block (its words, then its pairs), and the features' order by part."""
    n = max(len(hashes), 1)
    part = np.concatenate((spread(hashes, 0), spread(hashes[distinct // n], heads[distinct % n].astype(np.uint64) + np.uint64(1)))) % np.uint64(parts)
    part = part.astype(np.int64)
    return part, np.argsort(part, kind="stable")


def squeezed(data: bytes | pa.Buffer) -> bytes:
    return pa.Codec("zstd", LEVEL).compress(data, asbytes=True)


def unsqueezed(data: bytes, size: int) -> bytes:
    return pa.decompress(data, size, codec="zstd", asbytes=True) if size else b""


class Block:
    """Documents of a task until there are ``BLOCK_BYTES`` of them."""

    def __init__(self) -> None:
        self.vocabulary: defaultdict[bytes, int] = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.ids: list[np.ndarray] = []
        self.sizes: list[int] = []
        self.bytes = 0

    def add(self, text: bytes | None) -> None:
        n = 0
        for some in words(text or b""):
            self.ids.append(np.fromiter(map(self.vocabulary.__getitem__, some), np.int32, len(some)))
            n += len(some)
        self.sizes.append(n)
        self.bytes += len(text or b"") + 64

    def closed(self, parts: int) -> tuple[dict, list[dict]]:
        """What the block keeps of its documents, and what goes to each part."""
        known = sorted(self.vocabulary)
        rank = np.empty(len(known), np.int32)
        rank[[self.vocabulary[w] for w in known]] = np.arange(len(known), dtype=np.int32)
        ids = rank[np.concatenate(self.ids)] if self.ids else np.empty(0, np.int32)
        sizes = np.array(self.sizes, np.int64)
        hashes = np.array([zlib.crc32(w) for w in known], np.uint32)
        heads = np.array([int.from_bytes(w[:HEAD], "big") for w in known], np.uint32)
        distinct, times = np.unique(pairs(ids, sizes, len(known)), return_counts=True)
        part, order = placed(hashes, heads, distinct, parts)
        n = np.concatenate((np.bincount(ids, minlength=len(known)), times)).astype(np.uint32)
        # strings end with a line feed, which no word holds, so that a slice of the buffer is a list of them
        ended = pa.array([w + b"\n" for w in known], pa.large_binary())
        begun = pa.array([w + b" " for w in known], pa.large_binary())
        two = pc.binary_join_element_wise(begun.take(pa.array(distinct // max(len(known), 1))), ended.take(pa.array(distinct % max(len(known), 1))), pa.scalar(b"", pa.large_binary()))
        strings = pa.concat_arrays([ended, two]).take(pa.array(order))
        offsets, data = np.frombuffer(strings.buffers()[1], np.int64), strings.buffers()[2]
        own = {"sizes": sizes.tobytes(), "ids": squeezed(ids.tobytes()), "hashes": hashes.tobytes(), "heads": squeezed(heads.tobytes())}
        borders = [0, *(np.flatnonzero(np.diff(part[order])) + 1).tolist(), len(order)] if len(order) else [0]
        sent = []
        for a, b in zip(borders, borders[1:]):
            text = data.slice(int(offsets[a]), int(offsets[b] - offsets[a]))
            sent.append({"part": int(part[order[a]]), "n": b - a, "size": text.size, "strings": squeezed(text), "counts": squeezed(n[order[a:b]].tobytes())})
        return own, sent


_OWN = (("sizes", pa.large_binary()), ("ids", pa.large_binary()), ("hashes", pa.large_binary()), ("heads", pa.large_binary()))
_SENT = (("part", pa.int64()), ("n", pa.int64()), ("size", pa.int64()), ("strings", pa.large_binary()), ("counts", pa.large_binary()))


def blocks(docs: DataFrame, side: int, parts: int, names: list[str]) -> DataFrame:
    """Per block a row of kind ``own`` (its documents' ``rows`` and words) and rows of kind
    ``sent``, one a part. Blocks are numbered by task, so a task that runs again gives the same."""
    read = docs.select(F.col("text").cast("string").alias("t"), packed(names))
    schema = T.StructType([T.StructField("kind", T.StringType()), T.StructField("block", T.LongType()), T.StructField("rows", T.ArrayType(read.schema["row"].dataType))])
    for c, kind in _OWN + _SENT:
        schema.add(c, T.LongType() if kind == pa.int64() else T.BinaryType())

    def table(kind: str, number: int, rows: pa.Array, of: list[dict]) -> pa.RecordBatch:
        cells = [pa.array([x.get(c) for x in of], t) for c, t in _OWN + _SENT]
        first = [pa.array([kind] * len(of)), pa.array([number] * len(of), pa.int64()), rows]
        return pa.RecordBatch.from_arrays([*first, *cells], names=["kind", "block", "rows", *(c for c, _ in _OWN + _SENT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count, block, rows = TaskContext.get().partitionId(), 0, Block(), []

        def made() -> Iterator[pa.RecordBatch]:
            number = (side << 62) | (task << 31) | count
            own, sent = block.closed(parts)
            held = pa.concat_arrays(rows)
            yield table("own", number, pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held), [own])
            for at in range(0, len(sent), 64):
                some = sent[at : at + 64]
                yield table("sent", number, pa.nulls(len(some), pa.list_(held.type)), some)

        for batch in batches:
            texts, carried, since = batch.column(0).cast(pa.large_binary()), batch.column(1), 0
            for i in range(batch.num_rows):
                block.add(texts[i].as_py())
                if block.bytes >= BLOCK_BYTES:
                    rows.append(carried.slice(since, i + 1 - since))
                    yield from made()
                    pa.default_memory_pool().release_unused()
                    since, block, rows, count = i + 1, Block(), [], count + 1
            if since < batch.num_rows:
                rows.append(carried.slice(since))
        if block.sizes:
            yield from made()

    return read.mapInArrow(run, schema)


# --- the dictionary -----------------------------------------------------------------------


def _part(rows: pd.DataFrame) -> pd.DataFrame:
    """A part's dictionary: every distinct string's bucket, sums by bucket, buckets for the blocks."""
    rows = rows.sort_values("block")
    texts, counts = [], []
    for n, size, text, times in zip(rows["n"], rows["size"], rows["strings"], rows["counts"], strict=True):
        data = unsqueezed(text, size)
        ends = np.concatenate(([0], np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1)).astype(np.int64)
        texts.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(data)]))
        counts.append(np.frombuffer(unsqueezed(times, 4 * n), np.uint32))
    coded = pa.concat_arrays(texts).dictionary_encode()
    which, times = coded.indices.to_numpy(), np.concatenate(counts).astype(np.int64)
    bucket = np.fromiter((zlib.crc32(s[:-1]) % BUCKETS for s in coded.dictionary.to_pylist()), np.uint16, len(coded.dictionary))
    begins = np.concatenate(([0], np.cumsum(rows["n"].to_numpy())))
    target = np.repeat(rows["block"].to_numpy() >> 62, rows["n"].to_numpy()) == 1
    sums = []
    for side in (False, True):
        total = np.zeros(len(bucket), np.int64)
        np.add.at(total, which[target == side], times[target == side])  # of each distinct string
        by_bucket = np.zeros(BUCKETS, np.int64)
        np.add.at(by_bucket, bucket, total)
        sums.append(by_bucket)
    pa.default_memory_pool().release_unused()
    own = [k for k, b in enumerate(rows["block"]) if b >> 62 == 0]
    back = [bucket[which[begins[k] : begins[k + 1]]].tobytes() for k in own]
    part = int(rows["part"].iloc[0])
    out = pd.DataFrame({"block": rows["block"].to_numpy()[own], "part": part, "buckets": back, "s": None, "t": None})
    return pd.concat([pd.DataFrame({"block": [-1], "part": [part], "buckets": [None], "s": [sums[0]], "t": [sums[1]]}), out])


def gains(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Whole gains of the buckets, ``SCALE`` times the log of the ratio of smoothed shares."""
    total_s, total_t = float(s.sum()), float(t.sum())
    ratio = (t.astype(float) + 1) * (total_s + BUCKETS) / ((s.astype(float) + 1) * (total_t + BUCKETS))
    return np.array([math.floor(SCALE * math.log(x)) for x in ratio], np.int64)


def _summed(dictionary: DataFrame, side: str) -> np.ndarray:
    out = np.zeros(BUCKETS, np.int64)
    each = dictionary.where("block = -1").select(F.posexplode(side).alias("bucket", "n"))
    for r in each.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


# --- weights ------------------------------------------------------------------------------


def _weighed(parts: int, gain: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def one(held: pa.Array, own: dict, back: list[dict]) -> pa.RecordBatch:
        sizes, hashes = np.frombuffer(own["sizes"], np.int64), np.frombuffer(own["hashes"], np.uint32)
        ids = np.frombuffer(unsqueezed(own["ids"], 4 * int(sizes.sum())), np.int32)
        distinct, which = np.unique(pairs(ids, sizes, len(hashes)), return_inverse=True)
        heads = np.frombuffer(unsqueezed(own["heads"], 4 * len(hashes)), np.uint32)
        _, order = placed(hashes, heads, distinct, parts)
        told = np.concatenate([np.frombuffer(x["buckets"], np.uint16) for x in sorted(back, key=lambda x: x["part"])] or [np.empty(0, np.uint16)])
        mine = np.empty(len(order), np.int64)
        mine[order] = gain[told]
        of_words = np.concatenate(([0], np.cumsum(mine[ids])))
        of_pairs = np.concatenate(([0], np.cumsum(mine[len(hashes) :][which])))
        ends, lasts = np.cumsum(sizes), np.cumsum(np.maximum(sizes - 1, 0))
        total = of_words[ends] - of_words[ends - sizes] + of_pairs[lasts] - of_pairs[lasts - np.maximum(sizes - 1, 0)]
        n = sizes + np.maximum(sizes - 1, 0)
        weight = np.where(n > 0, total // np.maximum(n, 1), 0)
        return pa.RecordBatch.from_arrays([held, pa.array(sizes), pa.array(n), pa.array(weight)], names=["row", "n_words", "n_features", "weight"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held = batch.column("rows").slice(i, 1).flatten()
                own = {k: batch.column(k)[i].as_py() for k, _ in _OWN}
                yield one(held, own, batch.column("back")[i].as_py() or [])

    return run


def weigh(docs: DataFrame, target: DataFrame, names: list[str]) -> DataFrame:
    """``row`` (a struct of the columns ``names``), ``n_words, n_features, weight`` of every document."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-int(size) // PART_BYTES))
    wanted = blocks(target.select("text"), 1, parts, ["text"]).drop("rows")
    made = keep(blocks(docs, 0, parts, names).unionByName(wanted, allowMissingColumns=True), "features", by="kind")
    sent = made.where("kind = 'sent'").select("block", *(c for c, _ in _SENT))
    back = "block long, part long, buckets binary, s array<bigint>, t array<bigint>"
    dictionary = keep(sent.groupBy("part").applyInPandas(_part, back), "dictionary")
    forget(made, "kind=sent")
    gain = gains(_summed(dictionary, "s"), _summed(dictionary, "t"))
    own = made.where("kind = 'own' and rows is not null").select("block", "rows", *(c for c, _ in _OWN))
    told = dictionary.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("part", "buckets")).alias("back"))
    fields = T.StructType([T.StructField("row", own.schema["rows"].dataType.elementType), *[T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]])
    out = keep(own.join(told, "block", "left").mapInArrow(_weighed(parts, gain), fields), "weights")
    discard(made, dictionary)
    return out


# --- the draw -----------------------------------------------------------------------------


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Whole Gumbel noise from a hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-float(SCALE) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(weighed: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: str = SEED) -> DataFrame:
    """``weighed`` with ``score`` and, for the drawn, ``rank``: the best ``percent`` of the
    documents with ``min_words`` words or more, by score, then doc_id."""
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col("row.doc_id"), seed))
    may = F.col("n_words") >= min_words
    counted = scored.where(may).groupBy("score").count().collect()
    left = sum(r["count"] for r in counted) * percent // 100
    above, passed = [], 0
    for r in sorted(counted, key=lambda r: -r["score"]):
        if passed >= left:
            break
        above.append((r["score"], passed))
        passed += r["count"]
    least = above[-1][0] if above else None
    spark = weighed.sparkSession
    table = spark.createDataFrame(above, "score long, above long")  # a row a score of a bounded range
    drawn = may & (F.col("score") >= F.lit(least).cast("long")) if above else F.lit(False)
    order = Window.partitionBy("score").orderBy(F.col("row.doc_id").asc_nulls_last(), "n_features")
    best = scored.where(drawn).withColumn("place", F.row_number().over(order).cast("long")).join(F.broadcast(table), "score")
    best = best.withColumn("rank", F.col("above") + F.col("place"))
    best = best.withColumn("rank", F.when(F.col("rank") <= left, F.col("rank"))).select("row", "n_words", "n_features", "weight", "score", "rank")
    return best.unionByName(scored.where(~F.coalesce(drawn, F.lit(False))).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document."""
    return ranked(weigh(docs, target, ["doc_id"])).select("row.doc_id", "n_features", "weight", "score", "rank")


def draw(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: str = SEED) -> DataFrame:
    """The drawn documents, all columns with their texts."""
    names = docs.columns
    return ranked(weigh(docs, target, names), percent, min_words, seed).where("rank is not null").select(*unpacked(names))
