import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helixmill.llm import bpe, queries
from helixmill.llm.vocabulary import vocabulary

DOCS = "doc_id long, text string, ids string, `block` int"


@pytest.fixture(scope="module")
def ranks():
    return vocabulary()[0]


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_matches_library_and_round_trips(spark, ranks, library):
    texts = [None, "", " ", "a", "Straße naïve été", "x" * 3000, "  two  spaces\n\n", "日本語 text 🙂", "don't we'll 123 ***", "the the", "the the", "<|endoftext|>", "ab" * 500]
    rows = [(None if i == 3 else i, t, "clash", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in bpe.round_trip(docs, ranks, public_tokenizers.PATTERN).collect()}
    assert len(got) == len(texts)
    for k, t, *_ in rows:
        ids = library.encode_ordinary(t or "")
        assert got[k].n_tokens == len(ids), t
        assert got[k].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_encode_then_decode(spark, ranks, library):
    docs = spark.createDataFrame([(1, "hello world"), (2, None)], "doc_id long, text string")
    encoded = bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    assert {r.doc_id: r.ids for r in encoded.collect()} == {1: library.encode_ordinary("hello world"), 2: []}
    assert {r.doc_id: bytes(r.decoded) for r in bpe.decode(encoded, ranks).collect()} == {1: b"hello world", 2: b""}


def test_empty_table(spark, ranks):
    assert bpe.round_trip(spark.createDataFrame([], "doc_id long, text string"), ranks, public_tokenizers.PATTERN).count() == 0


def test_merge_of_long_runs(ranks, library):
    for piece in (b"a" * 5000, b"abc" * 700, bytes(range(256))):
        assert bpe.merge(piece, ranks) == library._core_bpe.encode_single_piece(piece)


def test_whole_table(spark, ranks, library):
    got = {r.doc_id: r for r in queries.op1_bpe(spark, "/root/testdata/sf0.001").collect()}
    for d in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        assert got[d.doc_id].ids_sha256 == hashlib.sha256(np.array(library.encode_ordinary(d.text), "<u4").tobytes()).hexdigest()
