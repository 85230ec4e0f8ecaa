"""Byte-level BPE: merges picked by segment trees over byte positions, and the way back from ids to bytes."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k"
#: The rank of a pair that doesn't merge, and a node's key: rank above, position below, so that the least key is the leftmost pair of the least rank.
NO_RANK = 1 << 30
SHIFT = 32
#: Pieces up to so many bytes are merged together in lockstep, so many at a time; longer ones one by one.
TOGETHER, BLOCK = 64, 1 << 14
#: Texts are encoded so many characters at a time, whole texts each.
CHARACTERS = 2_000_000


class Vocabulary:
    """Ranks of byte strings, with the rank of every pair of ids that makes a longer one."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = sorted(
            (self.ranks[t[:i]] << SHIFT | self.ranks[t[i:]], rank) for t, rank in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks
        )
        self.pairs = np.array([p for p, _ in pairs], np.int64)
        self.pair_ranks = np.array([r for _, r in pairs], np.int64)
        self.pair_of = dict(pairs)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; NO_RANK where they don't merge or one of them is -1."""
        wanted = left << SHIFT | right
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where((self.pairs[at] == wanted) & (left >= 0) & (right >= 0), self.pair_ranks[at], NO_RANK)


@lru_cache(maxsize=2)
def vocabulary(name: str = VOCABULARY) -> Vocabulary:
    return Vocabulary(public_tokenizers.path(f"{name}.tiktoken"))


def merge_together(pieces: list[bytes], words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all ``pieces`` in a row, and how many each has. Every piece makes its next merge at the same time.

    Row r of ``tree`` is the segment tree of piece r: the leaf at a live position holds the key of the pair that begins there, the root the least key. A
    merge writes three leaves (the pair's own, its right half's, and that of the live neighbour to the left) and the nodes above them.
    """
    m, lengths = len(pieces), np.array([len(p) for p in pieces], np.int64)
    width = 1 << int(max(lengths.max() - 1, 1)).bit_length()
    at = np.arange(width, dtype=np.int64)
    live = at < lengths[:, None]
    ids = np.full((m, width + 1), -1, np.int64)  # the last column stands for no neighbour
    ids[:, :width][live] = words.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
    after = np.where(at + 1 < lengths[:, None], at + 1, width)
    before = np.where(at > 0, np.broadcast_to(at - 1, (m, width)), width)
    after, before = (np.concatenate([x, np.full((m, 1), width)], axis=1) for x in (after, before))
    tree = np.empty((m, 2 * width), np.int64)
    tree[:, width:] = words.rank_of(ids[:, :width], np.take_along_axis(ids, after[:, :width], axis=1)) << SHIFT | at
    for node in range(width - 1, 0, -1):
        np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
    rows = np.arange(m)
    while len(rows := rows[tree[rows, 1] < NO_RANK << SHIFT]):
        best = tree[rows, 1]
        left, merged = best & ((1 << SHIFT) - 1), best >> SHIFT
        gone = after[rows, left]
        right, prior = after[rows, gone], before[rows, left]
        ids[rows, left], ids[rows, gone] = merged, -1
        after[rows, left], before[rows, right] = right, left
        tree[rows, width + gone] = NO_RANK << SHIFT | gone
        tree[rows, width + left] = words.rank_of(merged, ids[rows, right]) << SHIFT | left
        has = prior < width
        tree[rows[has], width + prior[has]] = words.rank_of(ids[rows[has], prior[has]], merged[has]) << SHIFT | prior[has]
        for leaf, of in ((gone, rows), (left, rows), (prior[has], rows[has])):
            node = (width + leaf) >> 1
            while node[:1].any():  # all are at the same depth
                tree[of, node] = np.minimum(tree[of, 2 * node], tree[of, 2 * node + 1])
                node >>= 1
    kept = ids[:, :width] >= 0
    return ids[:, :width][kept], kept.sum(axis=1)


def merge_alone(piece: bytes, words: Vocabulary) -> list[int]:
    """Ids of one long piece by the same tree, kept in lists."""
    n = len(piece)
    width = 1 << (n - 1).bit_length()
    ids, after, before = words.of_byte[np.frombuffer(piece, np.uint8)].tolist(), [*range(1, n), -1], list(range(-1, n - 1))
    none, pair_of = NO_RANK << SHIFT, words.pair_of
    tree = [none] * (2 * width)
    for i in range(n - 1):
        tree[width + i] = pair_of.get(ids[i] << SHIFT | ids[i + 1], NO_RANK) << SHIFT | i
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def put(leaf: int, key: int) -> None:
        node = width + leaf
        tree[node] = key
        while node := node >> 1:
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a < b else b

    def key(left: int) -> int:
        right = after[left]
        return none | left if right < 0 else pair_of.get(ids[left] << SHIFT | ids[right], NO_RANK) << SHIFT | left

    while tree[1] < none:
        left, ids_merged = tree[1] & ((1 << SHIFT) - 1), tree[1] >> SHIFT
        gone = after[left]
        ids[left], ids[gone], after[left] = ids_merged, -1, after[gone]
        if after[left] >= 0:
            before[after[left]] = left
        put(gone, none | gone)
        put(left, key(left))
        if before[left] >= 0:
            put(before[left], key(before[left]))
    return [i for i in ids if i >= 0]


def ids_of_pieces(pieces: list[bytes], words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the pieces in a row, and the places at which each begins (and the end). A piece that is a token itself is that token."""
    counts, parts = np.ones(len(pieces), np.int64), [np.empty(0, np.int64)]
    order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))
    whole = [i for i in order if pieces[i] in words.ranks]
    others = [i for i in order if pieces[i] not in words.ranks]
    parts.append(np.array([words.ranks[pieces[i]] for i in whole], np.int64))
    short = [i for i in others if len(pieces[i]) <= TOGETHER]
    for begin in range(0, len(short), BLOCK):
        block = short[begin : begin + BLOCK]
        ids, counts[block] = merge_together([pieces[i] for i in block], words)
        parts.append(ids)
    long = others[len(short) :]
    for i in long:
        ids = merge_alone(pieces[i], words)
        counts[i] = len(ids)
        parts.append(np.array(ids, np.int64))
    # bring the parts, which lie by length, back to the order of the pieces
    laid = np.array([*whole, *short, *long], np.int64)
    start = np.empty(len(pieces), np.int64)
    start[laid] = np.cumsum(counts[laid]) - counts[laid]
    return _gather(np.concatenate(parts), start, counts), np.concatenate([[0], np.cumsum(counts)])


def _gather(values: np.ndarray, start: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs ``values[start : start + count]`` one after another."""
    ends = np.cumsum(counts)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + counts, counts)]


def encode(docs: DataFrame, vocabulary_name: str = VOCABULARY, text: str = "text", ids: str = "ids") -> DataFrame:
    """The rows of ``docs`` without their text but with its ids, a column of ``array<int>``.

    Each match of the public pattern is encoded by itself, without special tokens. A null or empty text has no ids. Texts are read whole; a piece of n bytes takes
    n log n steps. Rows are independent: repeated rows and any ids come out as they came, an empty table stays empty, other columns come along (one of the name
    of ``ids`` is replaced). Nothing is shuffled; a task holds one Arrow batch, the ids of up to some 200,000 distinct pieces, and the ids of some 2 M characters
    and one text.
    """
    others = [c for c in docs.columns if c not in (text, ids)]
    rows = docs.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`").alias(ids))
    schema = rows.withColumn(ids, F.lit(None).cast("array<int>")).schema

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pattern = _Known(vocabulary(vocabulary_name)), regex.compile(public_tokenizers.PATTERN)
        for batch in batches:
            begin = held = 0
            texts = batch.column(len(others))
            for i in range(len(texts)):
                held += len(texts[i].as_py() or "")
                if held >= CHARACTERS or i + 1 == len(texts):
                    *kept, part = batch.slice(begin, i + 1 - begin).columns
                    yield pa.RecordBatch.from_arrays([*kept, known.encode(part.to_pylist(), pattern)], names=schema.names)
                    begin, held = i + 1, 0

    return rows.mapInArrow(encoded, schema)


class _Known(dict):
    """Numbers of the distinct pieces of a task, with their ids kept in one array; forgotten when they are many."""

    def __init__(self, words: Vocabulary, most: int = 200_000):
        super().__init__()
        self.words, self.most, self.new = words, most, []
        self.ids, self.start, self.count = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def __missing__(self, piece: str) -> int:
        self.new.append(piece)
        self[piece] = number = len(self)
        return number

    def encode(self, texts: list[str | None], pattern: regex.Pattern) -> pa.Array:
        if len(self) > self.most:
            self.clear()
            self.ids, self.start, self.count = self.ids[:0], self.start[:0], self.count[:0]
        found = [pattern.findall(t) if t else [] for t in texts]
        sizes = np.array([len(f) for f in found], np.int64)
        pieces = np.fromiter(map(self.__getitem__, chain.from_iterable(found)), np.int64, int(sizes.sum()))
        ids, starts = ids_of_pieces([p.encode() for p in self.new], self.words)
        self.new = []
        self.start = np.concatenate([self.start, starts[:-1] + len(self.ids)])
        self.count = np.concatenate([self.count, np.diff(starts)])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        counts = self.count[pieces]
        offsets = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(sizes)])]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(_gather(self.ids, self.start[pieces], counts)))


def decode(tokens: DataFrame, vocabulary_name: str = VOCABULARY, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The rows of ``tokens`` with the bytes of their ids as a further column (one of its name is replaced); null ids give null, no ids no bytes.

    An id outside the vocabulary or a null among the ids is an error. Rows are independent; an empty table stays empty.
    """
    tokens = tokens.drop(out)
    schema = tokens.withColumn(out, F.lit(None).cast("binary")).schema

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocabulary(vocabulary_name).tokens
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            made = [None if not row.is_valid else b"".join(_bytes_of(row.values, table)) for row in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=schema.names)

    return tokens.mapInArrow(decoded, schema)


def _bytes_of(row: pa.Array, table: list[bytes]) -> list[bytes]:
    values = row.to_numpy(zero_copy_only=not row.null_count)
    if row.null_count or (len(values) and (values.min() < 0 or values.max() >= len(table))):
        raise ValueError("an id that is not in the vocabulary")
    return [table[i] for i in values.tolist()]
