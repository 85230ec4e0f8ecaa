"""Packing token sequences into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import base64
import bisect
import heapq
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenizer(vocabulary: str = VOCABULARY) -> Callable[[str], np.ndarray]:
    """Text to the ids that the JSON vocabulary gives by default, without special tokens of its own at the ends.

    The ranks are those of the JSON vocabulary and give its ids at four times the speed. Texts that hold the string of a special token (one id there), and
    texts on which that splitter gives up (long runs of one kind of character), go to the JSON one.
    """
    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole = tokenizers.Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
    special = [t.content for t in whole.get_added_tokens_decoder().values()]

    def ids(text: str) -> np.ndarray:
        if not any(s in text for s in special):
            try:
                return fast.encode_to_numpy(text, disallowed_special=())
            except BaseException as e:
                if type(e).__name__ not in ("PanicException", "ValueError"):
                    raise
        return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)

    return ids


def differencing(sizes: list[int], windows: int) -> list[tuple[int, list[int]]]:
    """``windows`` near-equal windows as (sum, items), largest first, by the largest differencing method.

    A partial partition is its windows that aren't empty, largest first; its imbalance is the largest less the
    smallest. The two of the largest imbalance merge, the largest windows of one with the smallest of the other.
    """
    heap = [(-size, i, [(-size, [i])]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, at, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        free = max(0, windows - len(a))
        alone, rest = b[:free], b[free:]
        joined = [(a.pop(), y) for y in rest]
        for window in [*alone, *[(s + t, x + y) for (s, x), (t, y) in joined]]:
            bisect.insort(a, window, key=lambda w: w[0])
        least = a[-1][0] if len(a) == windows else 0
        heapq.heappush(heap, (a[0][0] - least, at, a))
    return [(-total, items) for total, items in heap[0][2]] if heap else []


def windows_of(lengths: np.ndarray, capacity: int) -> list[list[tuple[int, int, int]]]:
    """Windows of (document, start, length) that hold every token once, each of at most ``capacity``.

    Full windows are cut off long documents. What is left of each is dealt by differencing, remainders of over half a window as two halves, to as many windows as the
    tokens would fill; while any window exceeds the capacity, the window count rises by one and all are dealt anew. The windows stay as differencing made them, so
    what the count has risen by is spread over them as padding. Halves that meet again are one piece.
    """
    out: list[list[tuple[int, int, int]]] = []
    parts: list[tuple[int, int, int]] = []
    for document, length in enumerate(lengths.tolist()):
        whole = length - length % capacity
        out += [[(document, at, capacity)] for at in range(0, whole, capacity)]
        left = length - whole
        half = left // 2 if 2 * left > capacity else 0
        parts += [(document, at, n) for at, n in ((whole, half), (whole + half, left - half)) if n]
    sizes = [length for _, _, length in parts]
    count = max(1, -(-sum(sizes) // capacity))
    dealt = differencing(sizes, count)
    while dealt and dealt[0][0] > capacity:
        count += 1
        dealt = differencing(sizes, count)
    for _, items in dealt:
        window: list[tuple[int, int, int]] = []
        for document, start, length in sorted(parts[i] for i in items):
            if window and window[-1][0] == document:
                start, length = window[-1][1], window.pop()[2] + length
            window.append((document, start, length))
        out.append(window)
    return out


def report(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row (sequences, tokens, padding, documents, cut_documents, cuts) about the pieces of ``pack``; zeros for none.

    A sequence is padded to the capacity unless its length is a power of two. Documents are told by doc_id and length; rows of one doc_id and length count as one.
    """
    of_sequence = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    padded = F.when(F.bit_count(F.col("n")) == 1, 0).otherwise(capacity - F.col("n"))
    sequences = of_sequence.agg(F.count("*").alias("sequences"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.coalesce(F.sum(padded), F.lit(0)).alias("padding"))
    least = F.ceil(F.col("doc_tokens") / capacity)  # pieces that no packing can avoid
    of_document = pieces.groupBy("doc_id", "doc_tokens").agg((F.count("*") / F.count_if(F.col("start") == 0) - least).alias("cuts"))
    documents = of_document.agg(F.count("*").alias("documents"), F.count_if(F.col("cuts") > 0).alias("cut_documents"), F.coalesce(F.sum("cuts"), F.lit(0)).cast("long").alias("cuts"))
    return sequences.crossJoin(documents)  # one row each


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 1, batch_tokens: int = 400_000, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one per piece of a row of ``docs(doc_id, text)``.

    A row's ids are those of its text (null: none), then ``end_id``. Each task packs what it reads, in batches of some
    ``batch_tokens`` ids, so nothing is shuffled or gathered and the memory is that of a batch and its longest text. A
    sequence_id is the task's number and a count, the same when a lost task runs again. Repeated rows and null ids are
    packed like others; an empty table gives no pieces. With ``with_ids`` the pieces carry their ids. Other columns are
    ignored.
    """
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of, task, sequence = tokenizer(vocabulary), TaskContext.get().partitionId() << 36, 0
        held: list[np.ndarray] = []
        names: list[object] = []
        tokens = 0

        def flush() -> pd.DataFrame:
            nonlocal sequence
            rows = []
            for window in windows_of(np.array([len(h) for h in held]), capacity):
                offset = 0
                for document, start, length in window:
                    ids = held[document][start : start + length]
                    row = (names[document], start, length, zlib.crc32(ids.astype("<u4", copy=False)), len(held[document]), task + sequence, offset)
                    rows.append((*row, ids.astype("<i4")) if with_ids else row)
                    offset += length
                sequence += 1
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
            out["doc_id"] = out["doc_id"].astype("Int64")
            held.clear()
            names.clear()
            return out

        for batch in batches:
            for name, text in zip(batch["doc_id"].astype("Int64"), batch["text"]):
                ids = ids_of(text) if text else np.empty(0, np.uint32)
                held.append(np.append(ids, np.uint32(end_id)))
                names.append(name)
                tokens += len(ids) + 1
                if tokens >= batch_tokens:
                    yield flush()
                    tokens = 0
        if held:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(packed, schema)
