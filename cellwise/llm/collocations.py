"""Collocations: word sequences that occur together more often than their parts do, found by a trie whose first level, the words, is a broadcast double array."""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellwise.llm.store import keep
from cellwise.llm.tries import DoubleArray

#: Ends of pieces and of words become one byte each; A-Z become lower case.
PIECE, WORD = 0x0A, 0x20
FORM = bytes(PIECE if chr(b) in ".,;:!?\n\v\f\r" else WORD if chr(b) in " \t" else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Stands between language and word in a trie; no UTF-8 text holds it.
BETWEEN = b"\xff"
#: Texts are read so many bytes at a time, whole texts each; rows of word numbers hold so many, a longer piece stays whole; so many are counted at once.
BYTES, ROW, AT_ONCE = 8_000_000, 2_000, 4_000_000
COUNTS = "lang string, phrase string, f long"


class Words:
    """A trie of some words of all languages, and their numbers."""

    def __init__(self, rows: pa.Table):
        strings = [lang.encode() + BETWEEN + word.encode() for lang, word in zip(rows["lang"].to_pylist(), rows["phrase"].to_pylist())]
        order = sorted(range(len(strings)), key=strings.__getitem__)
        self.trie = DoubleArray([strings[i] for i in order])
        self.numbers = rows["number"].to_numpy()[order]

    def of(self, lang: str, words: pa.Array) -> np.ndarray:
        """The numbers of ``words``, -1 for those that aren't here."""
        out = np.full(len(words), -1, np.int64)
        if (state := self.trie.walk(lang.encode() + BETWEEN)) >= 0:
            text = np.frombuffer(b" ".join([*words.to_pylist(), b""]), np.uint8)
            ends = np.flatnonzero(text == WORD)
            for rows, numbers, after in self.trie.accepted(text, np.concatenate([[0], ends[:-1] + 1]), state):
                whole = after == ends[rows]
                out[rows[whole]] = self.numbers[numbers[whole]]
        return out


class Pairs:
    """The trie's second level for some pairs of words: its edges (number of the first word, number of the second) in order, and the pairs' numbers."""

    def __init__(self, rows: pa.Table):
        edges = rows["pair"].to_numpy()
        order = np.argsort(edges)
        self.edges, self.numbers = edges[order], rows["number"].to_numpy()[order]

    def of(self, codes: np.ndarray) -> np.ndarray:
        """The number of the pair that begins at each word, -1 for none of these."""
        out = np.full(len(codes), -1, np.int64)
        at = np.flatnonzero((codes[:-1] >= 0) & (codes[1:] >= 0))
        pairs = codes[at] << 32 | codes[at + 1]
        place = np.minimum(np.searchsorted(self.edges, pairs), len(self.edges) - 1)
        there = self.edges[place] == pairs
        out[at[there]] = self.numbers[place[there]]
        return out


def words_of(text: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, the place of each word among them, whether it goes on in its predecessor's piece)."""
    marks = np.frombuffer(b"\n%b\n" % text.translate(FORM), np.uint8)
    inside = (marks != WORD) & (marks != PIECE)
    begin, end = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1, np.flatnonzero(~inside[1:] & inside[:-1]) + 1
    if not len(begin):
        return pa.array([], pa.binary()), np.empty(0, np.int64), np.empty(0, bool)
    offsets = np.concatenate([[0], np.cumsum(end - begin)])
    words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(marks[inside])]).dictionary_encode()
    pieces = np.cumsum(marks == PIECE)[begin]
    return words.dictionary, words.indices.to_numpy(), np.concatenate([[False], pieces[1:] == pieces[:-1]])


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(language, texts of some BYTES, each ending its last piece) as they come."""
    held: dict[str, list[bytes]] = {}
    size: Counter[str] = Counter()
    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text").cast(pa.binary())):
            name = lang.as_py()
            held.setdefault(name, []).append(text.as_py())
            size[name] += len(held[name][-1])
            if size[name] >= BYTES:
                yield name, b"\n".join(held.pop(name))
                del size[name]
    for name, texts in held.items():
        yield name, b"\n".join(texts)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, count) of every word, and with a null word the number of all."""
    for lang, text in _by_lang(batches):
        words, place, _ = words_of(text)
        numbers = np.concatenate([[len(place)], np.bincount(place, minlength=len(words))])
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(numbers)), pa.array([None, *words.to_pylist()], pa.binary()).cast(pa.string()), pa.array(numbers, pa.int64())], names=["lang", "phrase", "f"])


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows``, kept, with a ``number`` from 0 on."""
    kept = keep(rows.withColumn("_id", F.monotonically_increasing_id()), name)
    part = F.shiftright("_id", 33)  # its partition; the other bits count there
    sizes = kept.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row per partition
    return keep(kept.join(F.broadcast(before), part == F.col("_part")).withColumn("number", F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id", "_part", "_before"), name)


def shards_of(rows: DataFrame, kind: Callable, most: int) -> Iterator[Broadcast]:
    """Tries that hold each of ``rows`` once, of some ``most`` rows each (that many in the mean, by number), sent to all tasks one after another."""
    count = -(-rows.count() // most)
    for i in range(count):
        shard = rows.sparkSession.sparkContext.broadcast(kind(rows.where(F.pmod("number", F.lit(count)) == i).toArrow()))
        yield shard
        shard.unpersist()


def word_numbers(texts: DataFrame, words: DataFrame, most: int) -> DataFrame:
    """Rows (codes) of word numbers as 32-bit integers, in the order of the texts: -1 parts pieces and stands for words that aren't in ``words(lang, phrase, number)``; what can't be part of a phrase is left out.

    One pass over the texts; for more words than one trie holds another for each, which fills in what that trie knows.
    """
    def filled(batches: Iterator[pa.RecordBatch], shard: Broadcast) -> Iterator[tuple[str, bytes, np.ndarray]]:
        for lang, text, codes in _coded(batches):
            words, place, _ = words_of(text)
            found = shard.value.of(lang, words)[place] if len(place) else np.empty(0, np.int64)
            yield lang, text, found if codes is None else np.where(found >= 0, found, codes)

    rows, last = texts, None
    for shard in shards_of(words, Words, most):
        if last is not None:
            def onward(batches: Iterator[pa.RecordBatch], shard: Broadcast = last) -> Iterator[pa.RecordBatch]:
                for lang, text, codes in filled(batches, shard):
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([text], pa.binary()), pa.array([codes.astype(np.int32).tobytes()], pa.binary())], names=["lang", "text", "codes"])

            rows = keep(rows.mapInArrow(onward, "lang string, text binary, codes binary"), "words")
        last = shard
    if last is None:
        return texts.sparkSession.createDataFrame([], "codes binary")

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, text, codes in filled(batches, last):
            yield pa.RecordBatch.from_arrays([pa.array(list(_rows(codes, words_of(text)[2])), pa.binary())], names=["codes"])

    return keep(rows.mapInArrow(streams, "codes binary"), "numbers")


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes, np.ndarray | None]]:
    """(language, texts, the numbers of their words so far), of texts or of rows that a pass left."""
    first = next(batches, None)
    if first is None:
        return
    every = itertools.chain([first], batches)
    if "codes" not in first.schema.names:
        yield from ((lang, text, None) for lang, text in _by_lang(every))
        return
    for batch in every:
        for lang, text, codes in zip(*(batch.column(c) for c in ("lang", "text", "codes"))):
            yield lang.as_py(), text.as_py(), np.frombuffer(codes.as_py(), np.int32).astype(np.int64)


def _rows(codes: np.ndarray, on: np.ndarray) -> Iterator[bytes]:
    """Runs of known words, each with -1 after it, some ROW numbers a row; words without a neighbour are left out."""
    if not len(codes):
        return
    place = np.arange(len(codes)) + np.cumsum(~on)
    stream = np.full(place[-1] + 2, -1, np.int32)
    stream[place] = codes
    known = stream >= 0
    stream[1:-1][known[1:-1] & ~known[:-2] & ~known[2:]] = -1
    known = stream >= 0
    stream = stream[known | np.concatenate([[False], known[:-1]])]
    ends = np.flatnonzero(stream < 0) + 1
    at = 0
    while at < len(stream):
        end = int(ends[np.searchsorted(ends, min(at + ROW, len(stream)))])
        yield stream[at:end].tobytes()
        at = end


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list[bytes]]]:
    """Rows of each column, of some AT_ONCE numbers together."""
    held: list[list[bytes]] = []
    size = 0
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns)):
            held.append(row)
            size += len(row[0])
            if size >= 4 * AT_ONCE:
                yield [list(column) for column in zip(*held)]
                held, size = [], 0
    if held:
        yield [list(column) for column in zip(*held)]


def _joined(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.int32).astype(np.int64)


def pair_counts(numbers: DataFrame, least: int) -> DataFrame:
    """(pair, f): pairs of words in a row, as first << 32 | second, that occur ``least`` times."""
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (rows,) in _groups(batches):
            codes = _joined(rows)
            at = np.flatnonzero((codes[:-1] >= 0) & (codes[1:] >= 0))
            pairs, counts = np.unique(codes[at] << 32 | codes[at + 1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts, pa.int64())], names=["pair", "f"])

    return numbers.mapInArrow(summed, "pair long, f long").groupBy("pair").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def longer_counts(numbers: DataFrame, pairs: DataFrame, least: int, most: int) -> DataFrame:
    """(step, pair, f): phrases of three and four words that occur ``least`` times, as their first pair << 32 | their last, which begins 1 or 2 words on.

    All pairs in a phrase are of ``pairs(pair, number)``, else it can't be frequent. One pass over the words' numbers; for more pairs than ``most`` another for each
    such part, which marks where its pairs begin.
    """
    def marked(batches: Iterator[pa.RecordBatch], shard: Broadcast) -> Iterator[tuple[list[bytes], np.ndarray]]:
        for columns in _groups(batches):
            marks = shard.value.of(_joined(columns[0]))
            yield columns[0], marks if len(columns) == 1 else np.maximum(marks, _joined(columns[1]))

    rows, last = numbers, None
    for shard in shards_of(pairs, Pairs, most):
        if last is not None:
            def onward(batches: Iterator[pa.RecordBatch], shard: Broadcast = last) -> Iterator[pa.RecordBatch]:
                for codes, marks in marked(batches, shard):
                    text, ends = marks.astype(np.int32).tobytes(), np.cumsum([len(row) for row in codes]).tolist()
                    parts = [text[a:b] for a, b in zip([0, *ends], ends)]
                    yield pa.RecordBatch.from_arrays([pa.array(codes, pa.binary()), pa.array(parts, pa.binary())], names=["codes", "marks"])

            rows = keep(rows.mapInArrow(onward, "codes binary, marks binary"), "marks")
        last = shard
    if last is None:
        return numbers.sparkSession.createDataFrame([], "step int, pair long, f long")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, marks in marked(batches, last):
            there = marks >= 0
            for step in (1, 2):
                at = np.flatnonzero(there[:-step] & there[1 : len(there) - step + 1] & there[step:])
                found, counts = np.unique(marks[at] << 32 | marks[at + step], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), step), pa.int32()), pa.array(found), pa.array(counts, pa.int64())], names=["step", "pair", "f"])

    return rows.mapInArrow(summed, "step int, pair long, f long").groupBy("step", "pair").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def frequent_phrases(docs: DataFrame, least: int = 30, most: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of the words and phrases of up to four words with at least ``least`` occurrences, and (lang, n), the number of words.

    ``docs(lang, text)``: A-Z are lowered, texts part into pieces at ``.,;:!?`` and line ends, pieces into words at spaces and tabs. A null lang is ``und``, a null
    text empty. No text, phrase or lang is too long; repeated rows count; other columns are ignored; an empty table has no phrases. Words are counted by a shuffle;
    a longer phrase can only be frequent where its parts are. So the texts are read once more, for the numbers of frequent words, and those numbers for the pairs,
    and for three and four words that consist of frequent pairs. A trie holds ``most`` words, or four times as many pairs; for more there is one more pass each.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    sums = texts.mapInArrow(_count_words, COUNTS).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    words = keep(sums.where((F.col("f") >= least) | F.col("phrase").isNull()), "words")
    single = words.where(F.col("phrase").isNotNull())
    known = numbered(single.select("lang", "phrase"), "words")
    numbers = word_numbers(texts, known, most)
    pairs = numbered(pair_counts(numbers, least), "pairs")
    longer = keep(longer_counts(numbers, pairs, least, 4 * most), "longer")

    first, last = F.shiftright("pair", 32).alias("first"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("last")
    of_pairs = pairs.select("number", "f", first, last).join(known.select("lang", F.col("phrase").alias("a"), F.col("number").alias("first")), "first")
    of_pairs = of_pairs.join(known.select(F.col("phrase").alias("end"), F.col("number").alias("last")), "last")
    of_pairs = keep(of_pairs.select("number", "lang", F.concat_ws(" ", "a", "end").alias("phrase"), "end", "f"), "phrases")
    of_longer = longer.select("step", "f", first, last).join(of_pairs.select("lang", F.col("phrase").alias("a"), F.col("number").alias("first")), "first")
    of_longer = of_longer.join(of_pairs.select("phrase", "end", F.col("number").alias("last")), "last")
    of_longer = of_longer.select("lang", F.concat_ws(" ", "a", F.when(F.col("step") == 1, F.col("end")).otherwise(F.col("phrase"))).alias("phrase"), "f")
    return single.unionByName(of_pairs.select("lang", "phrase", "f")).unionByName(of_longer), words.where(F.col("phrase").isNull()).select("lang", F.col("f").alias("n"))


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, cover: int = 80, most: int = 1_000_000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two to four words of each language of ``docs(lang, text)``, by ``frequent_phrases``.

    a, l and r are the occurrences of the phrase and of its parts at the cut of the least score, floor(2000000 * a / (l + r)), of equal ones the earliest. A phrase inside a longer
    one that has at least ``cover`` per cent of its occurrences goes. Ties in score go by a, falling, then by phrase in byte order. Scores are exact: products are
    decimals of 38 digits. Languages are ranked by a window that keeps ``top`` rows a task before it shuffles.
    """
    counts, totals = frequent_phrases(docs, least, most)
    counts = keep(counts, "frequent")
    size = F.size("words")
    phrases = counts.withColumn("words", F.split("phrase", " ")).where(size > 1).withColumnRenamed("f", "a")

    def run(begin: F.Column, length: F.Column) -> F.Column:
        return F.array_join(F.slice("words", begin, length), " ")

    cuts = phrases.withColumn("cut", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.select("lang", "phrase", "a", "cut", run(F.lit(1), F.col("cut")).alias("left"), run(F.col("cut") + 1, size - F.col("cut")).alias("right"))
    for part, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)), ["lang", part])
    cuts = cuts.withColumn("score", F.expr("(2000000 * CAST(a AS decimal(30, 0))) DIV (CAST(l AS decimal(30, 0)) + r)"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))

    longer = phrases.where(size > 2).withColumn("length", F.explode(F.sequence(F.lit(2), size - 1))).withColumn("begin", F.explode(F.sequence(F.lit(1), size - F.col("length") + 1)))
    covers = longer.select("lang", run(F.col("begin"), F.col("length")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    wide = F.col("longer").cast("decimal(30,0)") * 100 >= F.col("a").cast("decimal(30,0)") * cover
    left = scored.join(covers, ["lang", "phrase"], "left").where(~F.coalesce(wide, F.lit(False)))

    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = left.select("lang", "phrase", "a", "best.l", "best.r", "best.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
