"""Encoding round trips and counts against the libraries applied to whole texts."""

import hashlib

import numpy as np
import public_tokenizers as P
import pytest

from geodrift.llm import bpe, token_counts

RANKS = P.path("byte_bpe_50k.tiktoken")
TEXTS = [
    None, "", " ", "\n\n  \n", "a", "Plain words, twice. Plain words, twice.", "été là-bas × 3.5 don't we'll", "tab\tnbsp  x y  z\x1c w \x85 v",
    "日本語 テキスト。混ぜる", "<|endoftext|>", "x<|endoftext|> y <|endoftext|>z", "reed*** th&&& A%%% #$%", "a" * 5000, " " * 3000 + "end", "word " * 40000, "é ×. ÷! é. ü,", "emoji 👩‍👩‍👧 ok\r\nline",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate([*TEXTS, TEXTS[5]])]
    return spark.createDataFrame(rows, "doc_id long, text string, token_ids string, n_tokens int")


def test_round_trip(spark, docs):
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()}
    codec = bpe.encoding(RANKS, P.PATTERN)
    for i, text in enumerate(TEXTS):
        assert np.frombuffer(got[i].token_ids, "<u4").tolist() == codec.encode_ordinary(text or "")
        assert got[i].decoded == (text or "").encode()
    assert len(got) == len(TEXTS) + 1


def test_safe_pieces_join():
    for text in TEXTS[1:]:
        for most in (1, 3, 10):
            assert "".join(bpe.safe_pieces(text, most)) == text


def test_counts(spark, docs):
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, P.path("byte_bpe_50k.json")).collect()}
    whole = token_counts.library(P.path("byte_bpe_50k.json"))
    assert got == {i: len(whole.encode(t or "", add_special_tokens=False)) for i, t in enumerate([*TEXTS, TEXTS[5]])}


def test_empty_table(spark, docs):
    none = docs.limit(0)
    assert bpe.decode(bpe.encode(none, RANKS, P.PATTERN), RANKS, P.PATTERN).count() == 0
    assert token_counts.count_tokens(none, P.path("byte_bpe_50k.json")).count() == 0


def test_query_digest(spark):
    from geodrift.llm.queries import QUERIES

    rows = QUERIES["op6_byte_bpe"](spark, "/root/testdata/sf0.001").collect()
    text = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    codec = bpe.encoding(RANKS, P.PATTERN)
    assert len(rows) == len(text)
    for r in rows:
        ids = np.asarray(codec.encode_ordinary(text[r.doc_id] or ""), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((text[r.doc_id] or "").encode()).hexdigest()
