"""Byte-level BPE against the public library, on whole tables and odd texts."""

import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from cellwise.llm import bpe, queries

ODD = ["", "a" * 5000, "\n" * 999, "xyz" * 700, "日本語テキスト" * 30, " \t a\x1c  b 12345 don't DON'T", "🙂" * 200, "\x00\x01 ﻿", "<|endoftext|>", "é" * 65 + " ", "  lead and trail  "]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.vocabulary().ranks, special_tokens={})


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_the_query_equals_the_library_on_every_document(spark, library, sf):
    rows = {r.doc_id: r for r in queries.op11_segment_tree_bpe(spark, f"/root/testdata/{sf}").collect()}
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for doc in docs:
        text = doc.text or ""
        ids = library.encode_ordinary(text)
        got = rows[doc.doc_id]
        assert (got.n_tokens, got.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert got.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_odd_texts_nulls_repeats_and_other_columns(spark, library):
    rows = [(1, t, "x") for t in ODD] + [(None, None, "y"), (2, "same", None), (2, "same", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string")
    got = bpe.decode(bpe.encode(docs)).collect()
    assert sorted(([*r.ids], bytes(r.decoded)) for r in got) == sorted((library.encode_ordinary(t or ""), (t or "").encode()) for _, t, _ in rows)
    assert sum(r.doc_id is None for r in got) == 1
    assert bpe.decode(bpe.encode(docs.limit(0))).count() == 0


def test_null_ids_and_ids_outside_the_vocabulary(spark):
    frame = spark.createDataFrame([(1, None), (2, [])], "a int, ids array<int>")
    assert [r.decoded for r in bpe.decode(frame).orderBy("a").collect()] == [None, b""]
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(spark.createDataFrame([(1, [70000])], "a int, ids array<int>")).collect()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=90), min_size=1, max_size=20))
def test_lockstep_and_single_merges_agree(pieces):
    words = bpe.vocabulary()
    together, counts = bpe.merge_together(pieces, words)
    assert together.tolist() == [i for p in pieces for i in bpe.merge_alone(p, words)]
    assert counts.sum() == len(together)
    assert b"".join(words.tokens[i] for i in together) == b"".join(pieces)
