import os
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

os.environ["TOKENIZERS_PARALLELISM"] = "false"
import public_tokenizers

from cellwise.llm import packing, queries

SCHEMA = "doc_id long, text string, start int, length string"
JSON = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))  # as it comes: the string of a special token is its id


def test_differencing_is_near_equal():
    rng = random.Random(0)
    for _ in range(30):
        sizes, windows = [rng.randint(1, 2000) for _ in range(rng.randint(1, 200))], rng.randint(1, 40)
        found = packing.differencing(sizes, windows)
        assert sorted(i for _, items in found for i in items) == list(range(len(sizes)))
        assert len(found) <= windows and all(total == sum(sizes[i] for i in items) for total, items in found)
        assert max(t for t, _ in found) <= sum(sizes) / windows + max(sizes)
    assert [t for t, _ in packing.differencing([8, 7, 6, 5, 4], 2)] == [16, 14]
    assert packing.differencing([], 3) == []


@pytest.mark.parametrize("capacity", [8, 64, 2048])
def test_windows_hold_every_token_once(capacity):
    rng = random.Random(capacity)
    for _ in range(20):
        lengths = np.array([rng.choice([1, rng.randint(1, capacity), rng.randint(1, 5 * capacity)]) for _ in range(rng.randint(0, 60))], int)
        windows = packing.windows_of(lengths, capacity)
        tokens = sorted((d, i) for w in windows for d, s, n in w for i in range(s, s + n))
        assert tokens == [(d, i) for d, n in enumerate(lengths) for i in range(n)]
        sizes = [sum(n for _, _, n in w) for w in windows]
        assert all(0 < s <= capacity for s in sizes)


def test_differencing_decides_and_the_count_rises(monkeypatch):
    """The windows are those of the last differencing, and as many: ten halves of 30 don't go into three windows of 100."""
    asked = []
    real = packing.differencing
    monkeypatch.setattr(packing, "differencing", lambda sizes, windows: asked.append((sizes, windows)) or real(sizes, windows))
    windows = packing.windows_of(np.array([60] * 5), 100)
    assert [n for _, n in asked] == [3, 4] and sorted(sum(n for _, _, n in w) for w in windows) == [60, 60, 90, 90]
    asked.clear()
    assert sorted(sorted(d for d, _, _ in w) for w in packing.windows_of(np.array([50, 50, 45, 45, 40, 40]), 100)) == [[0, 5], [1, 4], [2, 3]]
    assert [n for _, n in asked] == [3]
    rng = random.Random(9)
    lengths = np.array([rng.randint(1, 2047) for _ in range(300)])
    asked.clear()
    windows = packing.windows_of(lengths, 2048)
    sizes, count = asked[-1]
    assert max(sizes) <= 1024 and count > -(-sum(sizes) // 2048) and all(real(sizes, n)[0][0] > 2048 for _, n in asked[:-1])
    assert sorted(sum(n for _, _, n in w) for w in windows) == sorted(total for total, _ in real(sizes, count))
    in_turn = lambda sizes, n: sorted(((sum(sizes[i::n]), list(range(len(sizes)))[i::n]) for i in range(min(n, len(sizes)))), reverse=True)
    monkeypatch.setattr(packing, "differencing", in_turn)
    assert len(packing.windows_of(lengths, 2048)) > 1.2 * len(windows)


def test_little_padding_and_few_cuts(spark):
    """Of the given documents: at most 2 % of all places are padding, and there are fewer pieces than in windows filled one after another (1,423)."""
    pieces = queries.QUERIES["op5_packing"](spark, "/root/testdata/sf0.01").cache()
    found = packing.report(pieces).first()
    assert found.padding <= 0.02 * (found.padding + found.tokens) and pieces.count() < 1400


def test_report(spark):
    rows = [(1, 0, 3, 0, 5, 7, 0), (1, 3, 2, 0, 5, 8, 0), (2, 0, 3, 0, 3, 8, 2), (None, 0, 4, 0, 4, 9, 0)]
    found = packing.report(spark.createDataFrame(rows, packing.PIECES), 8).first()
    assert tuple(found) == (3, 12, 8, 3, 1, 1)
    assert tuple(packing.report(spark.createDataFrame([], packing.PIECES)).first()) == (0, 0, 0, 0, 0, 0)


def plain(text):
    return JSON.encode(text or "", add_special_tokens=False).ids + [1]


def test_pieces_are_the_tokenizers_ids(spark):
    texts = ["", None, "a", "x <|endoftext|> y", "Ärger  \n\t größer 12345 'll don't", "word " * 5000, " " * 300_000, "a" * 30_000, "同じ文字列 😀" * 50]
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, "a", 1, "x"), (2, "a", 1, "x")]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    found = packing.pack(docs, batch_tokens=3000, with_ids=True).collect()
    assert found == packing.pack(docs, batch_tokens=3000, with_ids=True).collect()
    for name in {r.doc_id for r in found}:
        text = texts[name] if name is not None else "a"
        pieces = sorted((r for r in found if r.doc_id == name), key=lambda r: r.start)
        wanted = plain(text) * (2 if name == 2 else 1)
        if name == 2:
            assert [(r.start, r.ids) for r in pieces] == [(0, plain("a"))] * 2
            continue
        assert [i for r in pieces for i in r.ids] == wanted
        at = 0
        for r in pieces:
            assert (r.start, r.length, r.doc_tokens) == (at, len(r.ids), len(wanted))
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            at += r.length
    by = {}
    for r in found:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(docs.limit(0)).count() == 0


def test_the_fast_splitter_gives_the_json_vocabulary(spark):
    ids = packing.tokenizer()
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    for r in rows[:60]:
        assert ids(r.text).tolist() + [1] == plain(r.text)
    for text in ("<|endoftext|>", "a<|endoftext|><|endoftext|> b\n<|endoftext|", " <|endoftext|> Ünï", "<|startoftext|> <|im_end|> </s>"):
        assert ids(text).tolist() == JSON.encode(text, add_special_tokens=False).ids
    assert ids("<|endoftext|>").tolist() == [50256]


def test_the_query_against_brute_force(spark):
    """Every given document: each id in exactly one piece, by the plain tokenizer; pieces fill their sequences from 0 without gaps."""
    sf = "/root/testdata/sf0.001"
    found = queries.QUERIES["op5_packing"](spark, sf).collect()
    texts = {r.doc_id: plain(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    by, places = {}, {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r)
        places.setdefault(r.sequence_id, []).append(r)
    assert set(by) == set(texts)
    for name, ids in texts.items():
        at = 0
        for r in sorted(by[name], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()))
            at += r.length
        assert at == len(ids)
    for pieces in places.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
