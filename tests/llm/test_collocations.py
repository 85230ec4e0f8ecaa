"""Collocations against plain counting, and tries against dictionaries."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cellwise.llm import collocations
from cellwise.llm.tries import DoubleArray


def plain(docs, least=30, top=2000, cover=80):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            counts[lang].update(tuple(words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            inside = any(len(q) > len(p) and 100 * b >= cover * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items())
            score, _, l, r = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            if not inside:
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def result(frame):
    return sorted(map(tuple, frame.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.mark.parametrize("most", [250_000, 100])
def test_equals_plain_counting_with_one_and_with_many_tries(spark, most):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = [(r.lang, r.text) for r in table.select("lang", "text").collect()]
    expected = plain(docs, 40 if most == 100 else 30)
    assert len(expected) > 20 and result(collocations.collocations(table, least=40 if most == 100 else 30, most=most)) == expected


def test_odd_texts_nulls_ties_and_other_columns(spark):
    rng = np.random.default_rng(5)
    words = ["a", "b", "The", "THE", "é", "\x1c", "x\x00y", "日本", "don't", " "]
    ends = [" ", "  ", "\t", " \t ", ".", ", ", "\n", "\r\n", " ; ", "\x0b", "!?"]
    docs = [(lang, "".join(words[i] + ends[j] for i, j in zip(rng.integers(0, 10, 60), rng.choice(11, 60, p=[0.6] + [0.04] * 10)))) for lang in ["en", None, "und", "", "zh\x00"] for _ in range(6)]
    docs += [("en", None), ("en", ""), ("en", " . \t,\n"), ("fr", "w" * 100_000), (None, "u v w x " * 3000), ("en", docs[0][1]), ("en", docs[0][1])]
    frame = spark.createDataFrame([(lang, text, "z", 1) for lang, text in docs], "lang string, text string, phrase string, f int").repartition(5)
    got = result(collocations.collocations(frame, least=3, top=50))
    assert got == plain(docs, 3, 50) and len(got) > 50
    assert result(collocations.collocations(frame, least=3, top=50, most=500)) == got


def test_empty_table(spark):
    assert result(collocations.collocations(spark.createDataFrame([], "lang string, text string"))) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=8), min_size=1, max_size=80), st.binary(max_size=200))
def test_the_trie_accepts_its_strings_and_no_others(strings, text):
    strings = sorted(set(strings))
    trie = DoubleArray(strings)
    buffer = np.frombuffer(text, np.uint8)
    got = sorted((int(p), int(n), int(e)) for rows, numbers, after in trie.accepted(buffer, np.arange(len(text)), 0) for p, n, e in zip(rows, numbers, after))
    assert got == sorted((i, n, i + len(s)) for n, s in enumerate(strings) for i in range(len(text)) if text.startswith(s, i))
    assert all(trie.accepts[trie.walk(s)] == n for n, s in enumerate(strings))
    assert trie.walk(b"\xff" * 9) == -1


def test_a_large_trie_stays_dense():
    rng = np.random.default_rng(1)
    strings = sorted({bytes(rng.integers(97, 123, rng.integers(2, 12)).astype(np.uint8)) for _ in range(20_000)})
    trie = DoubleArray(strings)
    states = len({s[: i + 1] for s in strings for i in range(len(s))})
    assert all(trie.accepts[trie.walk(s)] == n for n, s in enumerate(strings)) and len(trie.base) < 1.6 * states


def test_passes_over_the_texts_grow_no_faster_than_the_tries(spark):
    """Pairs are sought within rows of numbers; however many parts hold the pairs, the texts are read for the words and their numbers alone."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("lang", "text")
    counts, _ = collocations.frequent_phrases(table, 10)
    assert counts.where("size(split(phrase, ' ')) = 2").count() > 4 * 25
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        read.add(1)
        yield from batches

    counted = table.repartition(1).mapInArrow(seen, table.schema)
    collocations.frequent_phrases(counted, 10)[0].count()
    once, read.value = read.value, 0
    collocations.frequent_phrases(counted, 10, 25)  # words and pairs in several parts
    assert once == read.value == 2


def test_numbers_of_words_in_rows():
    codes, on = np.array([5, 6, -1, 7, 8, 9, 3, 4, 2]), np.array([False, True, True, True, False, True, True, False, False])
    rows = [np.frombuffer(row, np.int32).tolist() for row in collocations._rows(codes, on)]
    assert rows == [[5, 6, -1, 8, 9, 3, -1]]  # neither one between unknown words nor one alone in its piece
    words, place, on = collocations.words_of("A b.a  B\tc, é".encode())
    assert [words.to_pylist()[i].decode() for i in place] == ["a", "b", "a", "b", "c", "é"] and on.tolist() == [False, True, False, True, True, False]
