import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tamarack.llm import shingles, tokens

ENCODE = tokens._library(tokens.FILE)[0]
ODD = st.text(st.sampled_from(list(" \n\t\r\x0b\x1c\x85\xa0\u1680\u2003\u2028\u202f\u205f　ab1.'<|>\0é😀")))


ENCODER = tokens.Encoder(tokens.FILE)


def check(texts, enc=ENCODER):
    ids, counts = [], []
    for _, data, offsets in shingles.slices(pa.array(texts, pa.string()), 64):
        flat, n = enc.ids(data, offsets)
        ids += [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])]
        counts += enc.counts(data, offsets).tolist()
    want = ENCODE(texts) if texts else []
    assert ids == want and counts == list(map(len, want))


@settings(max_examples=150, deadline=None)
@given(st.lists(ODD, max_size=6))
def test_pieces_give_the_ids_of_the_whole(texts):
    check(texts)


@pytest.mark.parametrize("window", [1, 7, 100])
def test_any_window_and_memory(monkeypatch, window):
    """Windows of a few bytes, calls of one piece, and a memory that is soon full."""
    for name, value in (("WINDOW_BYTES", window), ("CALL_BYTES", 1), ("JOIN", 20), ("MEMO_BYTES", 500)):
        monkeypatch.setattr(tokens, name, value)
    check(["", "the cat of the house <|endoftext|> the cat\n\nof  a tree", "x" * 300 + " y", "", "\u2003 a b", "ü" * 90 + " the cat"], tokens.Encoder(tokens.FILE))


def test_hashes_of_long_stretches(monkeypatch):
    """Chunks of any size give the same hashes."""
    data = np.random.default_rng(1).integers(0, 256, 5000, dtype=np.uint8)
    starts, ends = np.array([0, 10, 100, 4000]), np.array([5, 60, 3900, 4500])
    whole = shingles.piece_hashes(data, starts, ends)
    monkeypatch.setattr(shingles, "CHUNK", 64)
    assert shingles.piece_hashes(data, starts, ends).tolist() == whole.tolist()
    assert len(set(whole.tolist())) == 4


def test_special_strings_as_the_library_takes_them(spark):
    docs = spark.createDataFrame([(1, "a <|endoftext|> b<|endoftext|>"), (2, None), (3, "x " * 2000)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in tokens.count_tokens(docs).collect()}
    for r in docs.collect():
        ids = ENCODE([r["text"] or ""])[0]
        assert rows[r["doc_id"]]["n_tokens"] == len(ids)
        assert rows[r["doc_id"]]["over_limit"] == (len(ids) > 1024)
        assert rows[r["doc_id"]]["n_bytes"] == len((r["text"] or "").encode())


def test_fixture_and_odd_rows(spark, sf, odd_docs, no_docs):
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), odd_docs):
        want = sorted([(r["doc_id"], len(ENCODE([r["text"] or ""])[0])) for r in docs.collect()], key=repr)
        assert sorted([(r["doc_id"], r["n_tokens"]) for r in tokens.count_tokens(docs).collect()], key=repr) == want
    assert tokens.count_tokens(no_docs).count() == 0


def test_other_libraries(spark):
    docs = spark.createDataFrame([(1, "Hello  there"), (2, None)], "doc_id long, text string")
    for name in ("piece_bpe_32k.model", "word_bpe_49k.json"):
        want = len(tokens._library(name)[0](["Hello  there"])[0])
        assert {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(docs, name).collect()} == {1: want, 2: 0}
