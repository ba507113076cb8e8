"""Exact top-k BM25 search: an inverted index a shard, pruned by a pivot and block maxima.

Terms are runs of letters, digits and characters beyond ASCII, A-Z lower-cased, known by
64-bit hashes. Corpus statistics (documents, mean length, document frequencies) cover all
rows. A shard is a run of documents of a task, ordered so that blocks of ``BLOCK`` of them hold
alike ones; every (term, block) keeps its greatest impact. WAND's pivot is found for all
documents of a shard at once instead of cursor by cursor, as numpy can: terms are read by
falling bound until those left can't lift a document over the k-th best sum; of the documents
met so far, those whose sum and block maxima reach it are scored exactly from their own rows,
and the postings of the terms left are never read. Shards' top-k lists are merged by score,
then doc_id; weights come from the whole corpus, so the merge is exact.

Queries are taken in blocks (``QUERIES``, ``QUERY_TERMS``), which bounds what is broadcast and
held by the driver; an index is built once for ``WAVE`` blocks.

Defined cases: null texts are empty, and empty texts match nothing; a query without terms has
no hits; a repeated query term counts as often as it occurs; equal scores rank by doc_id;
repeated rows are hits of their own; rows without doc_id count in the statistics, but are
neither queries nor hits; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, keep
from .shingles import SEARCH_SPACE, slices, words

K1, B = 1.5, 0.75
TOP = 10
BLOCK = 64
SHARD_BYTES = 48 << 20
#: A block of queries has so many, and so many terms, at most on average; an index answers ``WAVE`` blocks.
QUERIES = 8192
QUERY_TERMS = 2_000_000
WAVE = 4
EVERY = 100
#: Terms in at least so many documents of a shard are added one by one, others together.
LONG_LIST = 256
#: Rows of more terms are searched for a query's terms, shorter ones are read.
LONG_ROW = 2048
#: Terms that one document in so many has are kept as dense lists, the commonest first, in so many bytes.
COMMON = 16
DENSE_BYTES = 32 << 20
#: Queries whose common terms are added at once.
TOGETHER = 64
#: What scoring a document from its row costs, in postings.
TERMS = 200
#: (term, document) rows a task holds before it counts them.
HELD = 4_000_000


def _terms(batch_text: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """``(first row, term, row, rows)`` of slices of a column of texts."""
    for at, data, offsets in slices(batch_text):
        term, row = words(data, offsets, SEARCH_SPACE)
        yield at, term, row, len(offsets) - 1


def _counted(term: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (term, row), sorted by term and row, with their counts."""
    order = np.lexsort((row, term))
    term, row = term[order], row[order]
    fresh = np.ones(len(term), bool)
    fresh[1:] = (term[1:] != term[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(fresh)
    return term[at], row[at], np.diff(np.concatenate((at, [len(term)])))


def frequencies(docs: DataFrame) -> DataFrame:
    """``kind, term, n``: kind 0 document frequencies, 1 the number of documents, 2 of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, n, long = [], 0, 0, 0

        def out(kind, term, count):
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(term), kind, np.int32)), pa.array(term.view(np.int64)), pa.array(count.astype(np.int64))], names=["kind", "term", "n"]
            )

        for batch in batches:
            for _, term, row, rows in _terms(batch.column(0)):
                n, long = n + rows, long + len(term)
                held.append(_counted(term, row)[0])
                size += len(held[-1])
                if size > HELD:
                    yield out(0, *np.unique(np.concatenate(held), return_counts=True))
                    held, size = [], 0
        if held:
            yield out(0, *np.unique(np.concatenate(held), return_counts=True))
        yield out(1, np.zeros(1, np.uint64), np.array([n]))
        yield out(2, np.zeros(1, np.uint64), np.array([long]))

    text = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    return text.mapInArrow(run, "kind int, term long, n long").groupBy("kind", "term").agg(F.sum("n").alias("n"))


def query_terms(queries: DataFrame) -> DataFrame:
    """``query, term, n`` of ``doc_id, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, term, row, rows in _terms(batch.column(1)):
                t, r, n = _counted(term, row)
                ids = batch.column(0).slice(at, rows)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(r)), pa.array(t.view(np.int64)), pa.array(n)], names=["query", "term", "n"])

    return queries.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "query long, term long, n long")


class Shard:
    """An inverted index with block maxima over documents in memory, and each document's own row."""

    def __init__(self, parts: list[np.ndarray], mean: float):
        """``parts``: documents' ids, then term and row (place among the ids) of every occurrence;
        the list is emptied, so that what the index needs no more is freed while it is built."""
        row, term, ids = parts.pop(), parts.pop(), parts.pop()
        n = len(ids)
        long = np.bincount(row, minlength=n)
        self.terms, term = np.unique(term, return_inverse=True)
        # (document, term) pairs as one number each, which numpy sorts fastest
        wide = max(1, len(self.terms))
        key, tf = np.unique(row * np.int64(wide) + term, return_counts=True)
        row, term = key // wide, key % wide
        del key
        place = self._order(ids, long, self.terms[term], row, tf)
        self.ids = np.empty_like(ids)
        self.ids[place] = ids
        impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * long[row] / mean))
        doc = place[row]
        del row, tf
        order = np.argsort(doc * wide + term)
        self.own_term, self.own_impact = term[order].astype(np.int32), impact[order]
        self.own = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=n))))
        order = np.argsort(term * np.int64(max(1, n)) + doc)
        term, self.doc, self.impact = term[order], doc[order], impact[order]
        del doc, order, impact
        at = np.flatnonzero(np.diff(term, prepend=-1))
        self.post = np.concatenate((at, [len(term)]))
        self.most = np.maximum.reduceat(self.impact, at) if len(at) else np.zeros(0)
        self.blocks = (n + BLOCK - 1) // BLOCK
        at = np.flatnonzero(np.diff(term * np.int64(max(1, self.blocks)) + self.doc // BLOCK, prepend=-1))
        self.block = self.doc[at] // BLOCK
        self.block_most = np.maximum.reduceat(self.impact, at) if len(at) else np.zeros(0)
        self.entry = np.searchsorted(at, self.post)
        self.weight = np.zeros(len(self.terms))
        df = np.diff(self.post)
        common = np.flatnonzero(df * COMMON >= n) if n else df[:0]
        common = common[np.argsort(-df[common], kind="stable")][: DENSE_BYTES // (8 * max(1, n))]
        self.dense = np.zeros((len(common), n))
        for i, t in enumerate(common):
            self.dense[i, self.doc[self.post[t] : self.post[t + 1]]] = self.impact[self.post[t] : self.post[t + 1]]
        self.column = np.full(len(self.terms), -1)
        self.column[common] = np.arange(len(common))

    @staticmethod
    def _order(ids: np.ndarray, long: np.ndarray, term: np.ndarray, row: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """Each document's place: those whose most frequent term is the same lie together, short
        ones first, so that a block's documents are alike and its maxima tight."""
        lead = np.zeros(len(ids), np.uint64)
        if len(row):
            first = np.flatnonzero(np.diff(row, prepend=-1))
            most = np.repeat(np.maximum.reduceat(tf, first), np.diff(first, append=len(row)))
            at = np.flatnonzero(tf == most)[::-1]  # the first such term is written last
            lead[row[at]] = term[at]
        place = np.empty(len(ids), np.int64)
        place[np.lexsort((ids, long, lead))] = np.arange(len(ids))
        return place

    @staticmethod
    def _spread(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """All integers of the ranges, one after the other."""
        n = end - start
        return np.repeat(end - np.cumsum(n), n) + np.arange(int(n.sum()))

    def _score(self, docs: np.ndarray, at: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Exact scores of documents for terms in ascending order. Equal documents get equal
        scores in any shard: the order of the sum depends on the row alone."""
        out, size = np.zeros(len(docs)), self.own[docs + 1] - self.own[docs]
        short = np.flatnonzero((size > 0) & (size <= LONG_ROW))
        if len(short):
            self.weight[at] = weight
            own = self._spread(self.own[docs[short]], self.own[docs[short] + 1])
            out[short] = np.add.reduceat(self.weight[self.own_term[own]] * self.own_impact[own], np.cumsum(size[short]) - size[short])
            self.weight[at] = 0
        for i in np.flatnonzero(size > LONG_ROW):
            row = slice(self.own[docs[i]], self.own[docs[i] + 1])
            own = np.minimum(np.searchsorted(self.own_term[row], at), size[i] - 1)
            hit = self.own_term[row][own] == at
            out[i] = (weight[hit] * self.own_impact[row][own[hit]]).sum()
        return out

    def _add(self, partial: np.ndarray, at: np.ndarray, weight: np.ndarray) -> int:
        """Add terms' contributions to all their documents; gives the postings read."""
        begin, end = self.post[at], self.post[at + 1]
        few = end - begin < LONG_LIST
        if few.any():
            post = self._spread(begin[few], end[few])
            partial += np.bincount(self.doc[post], np.repeat(weight[few], (end - begin)[few]) * self.impact[post], len(partial))
        for b, e, w in zip(begin[~few].tolist(), end[~few].tolist(), weight[~few].tolist(), strict=True):
            partial[self.doc[b:e]] += w * self.impact[b:e]
        return int((end - begin).sum())

    def top(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """For each query's terms and weights: ids and scores of the k best, and the entries read.

        Terms of a large share of the documents are added first, for ``TOGETHER`` queries at once;
        the k-th best sum is the first threshold. The other terms follow by falling bound (weight
        times greatest impact) up to the pivot: what is left adds less than the threshold, so no
        document that has only those can be a hit. From there on a document stays while its sum and
        the block maxima of the terms left reach the threshold, and who stays is scored from its
        own row; the postings of the terms left are skipped.
        """
        for begin in range(0, len(queries), TOGETHER):
            some = []
            weights = np.zeros((min(TOGETHER, len(queries) - begin), len(self.dense)))
            for i, (term, weight) in enumerate(queries[begin : begin + TOGETHER]):
                at = np.searchsorted(self.terms, term)
                ok = at < len(self.terms)
                ok[ok] = self.terms[at[ok]] == term[ok]
                at, weight = at[ok], weight[ok]
                column = self.column[at]
                weights[i, column[column >= 0]] = weight[column >= 0]
                some.append((at, weight, column < 0))
            sums = weights @ self.dense
            for (at, weight, sparse), partial in zip(some, sums, strict=True):
                docs, n = self._candidates(partial, at[sparse], weight[sparse], k)
                score = self._score(docs, at, weight)
                best = np.lexsort((self.ids[docs], -score))[:k]
                yield self.ids[docs[best]], score[best], n

    def _candidates(self, partial: np.ndarray, at: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, int]:
        """Documents that may be among the k best, given the sums of the common terms, and the postings read."""
        bound = weight * self.most[at]
        order = np.argsort(-bound, kind="stable")
        at, weight, bound = at[order], weight[order], bound[order]
        rest = np.concatenate((np.cumsum(bound[::-1])[::-1], [0.0]))
        left = np.concatenate((np.cumsum((self.post[at + 1] - self.post[at])[::-1])[::-1], [0]))

        def kth() -> float:
            # sums only grow, so the k-th best sum bounds the k-th best score from below
            return np.partition(partial, -k)[-k] if len(partial) > k else 0.0

        done, read, least = 0, 0, kth()
        goal = least if least > 0 else rest[0] / 2
        while True:
            to = int(np.searchsorted(-rest, -goal))
            if to > done:
                read += self._add(partial, at[done:to], weight[done:to])
                done, least = to, kth()
            goal = min(goal, rest[done]) / 4 if left[done] > LONG_LIST else 0.0
            # bounds add up in another order than scores: leave room for rounding
            docs = np.flatnonzero((partial > 0) & ((partial + rest[done]) * (1 + 1e-9) >= least))
            if done == len(at):
                return docs, read
            if rest[done] * (1 + 1e-9) >= least or len(docs) * TERMS > left[done]:
                continue
            begin, end = self.entry[at[done:]], self.entry[at[done:] + 1]
            entry = self._spread(begin, end)
            more = np.bincount(self.block[entry], np.repeat(weight[done:], end - begin) * self.block_most[entry], self.blocks)
            docs = docs[(partial[docs] + more[docs // BLOCK]) * (1 + 1e-9) >= least]
            return docs, read


def _found(docs: DataFrame, blocks: list[Broadcast], mean: float, k: int) -> DataFrame:
    """Each shard's top-k for the queries of some blocks (their ids, ends, terms, weights)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, terms, rows, n, size = [], [], [], 0, 0

        def search() -> Iterator[pa.RecordBatch]:
            parts = [np.concatenate(x) for x in (ids, terms, rows)]
            for x in (ids, terms, rows):
                x.clear()
            shard = Shard(parts, mean)
            for block in blocks:
                asked, ends, term, weight = block.value
                each = list(zip(np.split(term, ends[:-1]), np.split(weight, ends[:-1]), strict=True))
                out = list(shard.top(each, k))
                names = np.repeat(asked, [len(i) for i, *_ in out])
                found, score = np.concatenate([i for i, *_ in out]), np.concatenate([s for _, s, _ in out])
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(found), pa.array(score)], names=["query", "doc_id", "score"])

        for batch in batches:
            for at, term, row, count in _terms(batch.column(1)):
                ids.append(batch.column(0).slice(at, count).to_numpy(zero_copy_only=False))
                terms.append(term)
                rows.append(row + n)
                n, size = n + count, size + len(term) * 6
                if size > SHARD_BYTES:
                    yield from search()
                    n = size = 0
        if n:
            yield from search()

    text = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return text.mapInArrow(run, "query long, doc_id long, score double")


def _block(per: DataFrame, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's queries: ids, where each one's terms end, terms (ascending a query) and weights."""
    rows = per.where(F.col("block") == b).select("query", "term", "w").toArrow()
    asked, term, w = (c.combine_chunks() for c in rows.columns)
    ends = np.cumsum(pc.list_value_length(term).to_numpy().astype(np.int64))
    term, w = term.flatten().to_numpy().view(np.uint64), w.flatten().to_numpy()
    order = np.lexsort((term, np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))))
    return asked.to_numpy(), ends, term[order], w[order]


def top_k(docs: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """``query, doc_id, score, rank`` of the k best documents of every query (``doc_id, text``)."""
    spark = docs.sparkSession
    stats = keep(frequencies(docs), "search-stats")
    sums = {r["kind"]: r["n"] for r in stats.where("kind > 0").collect()}
    n, mean = sums.get(1, 0), max(1e-9, sums.get(2, 0) / max(1, sums.get(1, 0)))
    df = stats.where("kind = 0").select("term", F.col("n").alias("df"))
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = query_terms(queries.where("doc_id is not null")).groupBy("query", "term").agg(F.max("n").alias("n"))
    weighed = asked.join(df, "term").select("query", "term", (F.col("n") * idf).alias("w"))
    kept = keep(weighed.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("t")).select("query", F.col("t.term").alias("term"), F.col("t.w").alias("w")), "search-queries")
    size = kept.agg(F.count("*").alias("n"), F.sum(F.size("term")).alias("terms")).first()
    blocks = max(1, -(-size["n"] // QUERIES), -(-(size["terms"] or 0) // QUERY_TERMS))
    per = kept.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)))
    some = sorted(r["block"] for r in per.select("block").distinct().collect())
    found = spark.createDataFrame([], "query long, doc_id long, score double")
    for at in range(0, len(some), WAVE):
        held = [spark.sparkContext.broadcast(_block(per, b)) for b in some[at : at + WAVE]]
        found = found.unionByName(keep(_found(docs, held, mean, k), "search-found"))
        for b in held:
            b.destroy()
    discard(stats, kept)
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "doc_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search(docs: DataFrame, k: int = TOP) -> DataFrame:
    """Every document whose id is divisible by ``EVERY``, with its whole text, against all."""
    return top_k(docs, docs.where(F.col("doc_id") % EVERY == 0), k)
