"""SimHash fingerprints of whole texts, linked through BK-trees over shards of fingerprints."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwise.llm.cells import to_cells, whole_cells
from cellwise.llm.components import components
from cellwise.llm.store import keep


def shingle_hashes(text: str | None, width: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of the text's word shingles, some at a time; a text of fewer words is one shingle, one of none has none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: only A-Z and ASCII white space
    if not words:
        return
    joined, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - width + 1)
    starts, stops = [0, *(ends[: n - 1] + 1).tolist()], ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 65536):  # bounded memory for very long texts
        yield np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + 65536], stops[at : at + 65536])], "<u8")


def ones_of(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """64 bits; each is 1 if set in over half of the XXH64 of the text's word shingles. No words: 0."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, width, seed):
        ones += ones_of(hashes)
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


LANES, BANDS, ROWS = 4, 8, 3
_MIX = np.random.default_rng(42).integers(1, 1 << 63, (2, LANES + BANDS * ROWS), dtype=np.uint64) | np.uint64(1)


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted hashes of a text's different shingles."""
    parts = list(shingle_hashes(text, width))
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, "<u8")


def wide_fingerprint(text: str | None, width: int = 5) -> tuple[bytes, list[int], bytes]:
    """A fingerprint of 256 bits over the different shingles, the keys of the shards in which it is looked for, and a digest of the shingle set.

    A shard's key is made of the least of 3 permuted hashes: texts of a Jaccard similarity of 0.8 share at least one of the 8 keys but once in 300.
    """
    hashes = shingle_set(text, width)
    copy = hashlib.blake2b(hashes, digest_size=16).digest()
    if not len(hashes):
        return bytes(8 * LANES), [0], copy
    ones, least = np.zeros((LANES, 64), np.int64), np.full(BANDS * ROWS, np.uint64(2**64 - 1))
    for at in range(0, len(hashes), 65536):
        some = hashes[at : at + 65536]
        for k in range(LANES + BANDS * ROWS):
            mixed = (some ^ _MIX[0, k]) * _MIX[1, k]
            mixed ^= mixed >> np.uint64(32)
            if k < LANES:
                ones[k] += ones_of(mixed * _MIX[1, k])
            else:
                least[k - LANES] = min(least[k - LANES], mixed.min())
    keys = [xxhash.xxh64_intdigest(bytes([b]) + least[b * ROWS : (b + 1) * ROWS].tobytes()) - (1 << 63) for b in range(BANDS)]
    return np.packbits(2 * ones.ravel() > len(hashes), bitorder="little").tobytes(), keys, copy


def jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """The similarity of two sorted sets; 0 without a look inside if their sizes alone keep it under ``least``."""
    small, large = sorted((len(a), len(b)))
    if not large:
        return 1.0
    if small / large < least:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (small + large - both)


def radius_of(similarity: float, bits: int = 64 * LANES) -> int:
    """Bits in which fingerprints of two shingle sets of that Jaccard similarity or more differ at most, but once in a million.

    That is five standard deviations beyond the expected share: for long texts that of the angle between their sums of signs, for sets
    of few shingles up to 3/16 (4 of 5 shingles shared, the most of all sizes at a similarity of 0.8).
    """
    share = max(math.acos(2 * similarity / (1 + similarity)) / math.pi, few_share(similarity))
    return min(bits, math.ceil(bits * share + 5 * math.sqrt(bits * share * (1 - share))))


def few_share(similarity: float, most: int = 24) -> float:
    """The largest chance that majorities over two sets of up to ``most`` shingles differ in a bit, over all sizes of that similarity."""
    worst = 0.0
    for a in range(1, most + 1):
        for b in range(a, most + 1):
            for both in range(1, a + 1):
                if both / (a + b - both) >= similarity:
                    chance = 0.0
                    for ones in range(both + 1):
                        p, q = (sum(math.comb(n - both, k) for k in range(n - both + 1) if 2 * (ones + k) > n) / 2 ** (n - both) for n in (a, b))
                        chance += math.comb(both, ones) / 2**both * (p * (1 - q) + q * (1 - p))
                    worst = max(worst, chance)
    return worst


def with_fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """Rows (doc_id, bits), one per document; bits is the fingerprint as a signed long."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bits = np.fromiter((fingerprint(t, width) for t in batch["text"]), "<u8", len(batch))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "bits": bits.view("<i8")})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(score, "doc_id long, bits long")


class BKTree:
    """A Burkhard-Keller tree over integers by Hamming distance; children are keyed by their distance to the parent.

    ``link`` finds the values within the radius of a new one, following only edges that the triangle inequality
    allows, then inserts it. For components, not all pairs are wanted: a subtree that lies wholly in
    the component which the new value already has is passed over, and each union yields one link.
    """

    def __init__(self, radius: int) -> None:
        self.radius = radius
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        self.parent: list[int] = []  # of the union-find forest
        self.uniform: list[bool] = []  # all of the subtree is in one component

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    def search(self, value: int) -> list[int]:
        """All values within the radius."""
        found, stack = [], [0] if self.values else []
        while stack:
            i = stack.pop()
            d = (self.values[i] ^ value).bit_count()
            if d <= self.radius:
                found.append(self.values[i])
            stack.extend(c for k, c in self.children[i].items() if abs(k - d) <= self.radius)
        return found

    def link(self, value: int, accept: Callable[[int], bool] | None = None) -> list[int]:
        """Insert a value; the places of values within the radius (that ``accept`` takes), one for each component that it joins."""
        new, links, radius = len(self.values), [], self.radius
        values, children, uniform = self.values, self.children, self.uniform
        self.parent.append(new)
        root = new
        stack = [0] if new else []
        while stack:
            i = stack.pop()
            if uniform[i] and root != new and self.find(i) == root:
                continue
            d = (values[i] ^ value).bit_count()
            if d <= radius and (there := self.find(i)) != root and (accept is None or accept(i)):
                links.append(i)
                self.parent[root], root = there, there
            low, high = d - radius, d + radius
            for k, c in children[i].items():
                if low <= k <= high:
                    stack.append(c)
        at, path = 0, []
        while new:
            path.append(at)
            d = (values[at] ^ value).bit_count()
            if d not in children[at]:
                children[at][d] = new
                break
            at = children[at][d]
        values.append(value)
        children.append({})
        uniform.append(True)
        for i in path:
            if uniform[i] and self.find(i) != root:
                uniform[i] = False
        return links


def shard_keys(bits: Column, radius: int, blocks: int) -> Column:
    """Of ``blocks`` bit ranges, two fingerprints that differ in ``radius`` bits share at least ``blocks - radius``."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(cuts, cuts[1:])]
    keys = []
    for k, chosen in enumerate(combinations(masks, blocks - radius)):
        mask = sum(chosen)
        keys.append(F.xxhash64(F.lit(k), bits.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))))
    return F.array(*keys)


def fingerprint_links(bits: DataFrame, radius: int = 4, blocks: int = 6, limit: int = 20_000) -> DataFrame:
    """Links (a, b) that connect all distinct ``bits`` within ``radius`` of one another, directly or by each other.

    A shard holds the fingerprints that agree in ``blocks - radius`` of ``blocks`` bit ranges; one BK-tree is built
    and searched per shard, within the task that the shuffle sends it to. More blocks make shards smaller and more numerous: 6
    give 15 shards of some 21 bits each, 7 give 35 of 27 (from about 10^8 fingerprints on).
    """

    shards = bits.select("bits", F.explode(shard_keys(F.col("bits"), radius, blocks)).alias("bucket"))
    return tree_links(to_cells(shards, "bits", limit), "bits", "bits", radius)


def tree_links(cells: DataFrame, node: str, value: str, radius: int, similarity: float | None = None) -> DataFrame:
    """Links (a, b) between nodes of a cell whose values a BK-tree finds within the radius. Values are longs or bytes.

    With ``similarity`` a link also needs that much of the sets in the cells' column ``shingles``: then the tree only proposes.
    """

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, bounds in whole_cells(batches):
            nodes, values = frame["node"].to_numpy(), frame["value"].tolist()
            ends: list[tuple[int, int]] = []
            for k in np.flatnonzero(np.diff(bounds) > 1):
                tree, at = BKTree(radius), bounds[k]
                sets = [np.frombuffer(x, "<u8") for x in frame["shingles"].iloc[at : bounds[k + 1]]] if similarity is not None else []
                for i, v in enumerate(values[at : bounds[k + 1]]):
                    accept = None if similarity is None else (lambda j, own=sets[i]: jaccard(own, sets[j], similarity) >= similarity)
                    # places in the tree are places in the cell
                    ends += [(at + j, at + i) for j in tree.link(int.from_bytes(v, "little") if isinstance(v, bytes) else int(v) & 0xFFFFFFFFFFFFFFFF, accept)]
            at = np.array(ends, np.int64).reshape(-1, 2)
            yield pd.DataFrame({"a": nodes[at[:, 0]], "b": nodes[at[:, 1]]})

    columns = ["cell", F.col(node).alias("node"), F.col(value).alias("value"), *(["shingles"] if similarity is not None else [])]
    return cells.select(*columns).mapInPandas(grow, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4, blocks: int = 6, limit: int = 20_000) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one per row of ``docs(doc_id, text)``; other columns are ignored.

    Fingerprints link at ``radius`` or fewer differing bits; component_id is the least doc_id reachable by links.
    Copies collapse to one fingerprint before any search, so their number adds no links. Null or blank texts have
    fingerprint zero, linked like any other. A null doc_id stays null and is never a component_id unless no other is in its
    component; repeated rows come back as often as they came. An empty table gives an empty result.
    """
    marked = keep(with_fingerprints(docs, width), "fingerprints")
    distinct = keep(marked.groupBy("bits").agg(F.min("doc_id").alias("least")), "distinct")
    links = fingerprint_links(distinct, radius, blocks, limit)
    # nodes of the graph sort as their least doc_id does, so a component's root tells its id
    name = distinct.select("bits", F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("id"), "bits").alias("name"))
    links = links.join(name.select(F.col("bits").alias("a"), F.col("name").alias("from")), "a").join(name.select(F.col("bits").alias("b"), F.col("name").alias("to")), "b")
    linked = components(links.select(F.col("from").alias("a"), F.col("to").alias("b"))).select("id.bits", F.col("root.id").alias("reach"))
    # written, so that the last join has an exchange on both sides, and a fingerprint of very many copies can be split
    ids = keep(distinct.join(linked, "bits", "left").select("bits", F.coalesce("reach", "least").alias("component_id")), "ids")
    return marked.join(ids, "bits").select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def _row_of(doc_id: Column, text: Column) -> Column:
    """What tells a row: its doc_id (null last) and its text's digest (a null text's is empty). Rows that agree in both are copies."""
    digest = F.coalesce(F.unhex(F.sha2(text, 256)), F.unhex(F.lit("")))
    return F.struct(doc_id.isNull().alias("none"), doc_id.cast("long").alias("id"), digest.alias("digest"))


def similar_rows(docs: DataFrame, similarity: float = 0.8, width: int = 5, limit: int = 2000) -> DataFrame:
    """Rows (row, first), one per row of ``docs(doc_id, text)``: structs (none, id, digest), that of the row and the first of its group.

    A group is connected by texts whose ``width``-word shingle sets have that similarity. It takes more bits than agreeing bit ranges of 64 can find. So
    the fingerprints have 256, and a BK-tree's radius is one beyond which the similarity is not to be expected; what it proposes is held against
    the whole shingle sets. A shard holds the texts that agree in three least permuted hashes; each text is in 8. Texts of equal sets collapse
    first, and a shard that is too large is split like any other. Sets are made again for the texts that meet another in a shard, so that
    those of all others are never written or sent. Blank and null texts have the empty set and are copies of each other. Rows are
    told by doc_id and text, so several texts of one doc_id and those of null doc_ids are judged each for itself; repeated rows come back as
    often as they came. Other columns are ignored; an empty table gives an empty result.
    """

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bits, keys, copy = zip(*[wide_fingerprint(t, width) for t in batch["text"]]) if len(batch) else ([], [], [])
            yield pd.DataFrame({"id": batch["id"].astype("Int64"), "digest": batch["digest"], "copy": copy, "bits": bits, "keys": keys})

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"node": batch["node"], "bits": batch["bits"], "shingles": [shingle_set(t, width).tobytes() for t in batch["text"]]})

    texts = docs.select(_row_of(F.col("doc_id"), F.col("text")).alias("row"), "text")
    marked = texts.select("row.id", "row.digest", "text").mapInPandas(score, "id long, digest binary, copy binary, bits binary, keys array<long>")
    row = F.struct(F.col("id").isNull().alias("none"), "id", "digest").alias("row")
    marked = keep(marked.select(row, "copy", "bits", "keys"), "fingerprints")
    # of copies, the first row's text is read again, and it is their node in the graph
    distinct = marked.groupBy("copy").agg(F.min("row").alias("row"), F.first(F.struct("bits", "keys")).alias("mark"))
    distinct = keep(distinct.select("copy", "row", "mark.*").withColumn("node", F.monotonically_increasing_id()), "distinct")
    buckets = distinct.select("node", F.explode("keys").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    found = keep(buckets.join(shared, "bucket"), "shards")
    wanted = keep(distinct.join(found.select("node").distinct(), "node").select("node", "bits", "row"), "wanted")
    same = [texts["row"][c].eqNullSafe(wanted["row"][c]) for c in ("id", "digest")]
    again = texts.join(wanted, same[0] & same[1]).dropDuplicates(["node"])
    whole = keep(again.select("node", "bits", "text").mapInPandas(sets, "node long, bits binary, shingles binary"), "shingles")
    met = found.join(whole, "node")
    links = tree_links(to_cells(met, "node", limit), "node", "bits", radius_of(similarity), similarity)
    name = distinct.select("node", "row")
    links = links.join(name.select(F.col("node").alias("a"), F.col("row").alias("from")), "a").join(name.select(F.col("node").alias("b"), F.col("row").alias("to")), "b")
    linked = components(links.select(F.col("from").alias("a"), F.col("to").alias("b"))).select(F.col("id").alias("row"), "root")
    firsts = distinct.select("copy", "row").join(linked, "row", "left").select("copy", F.coalesce("root", "row").alias("first"))
    return marked.select("row", "copy").join(firsts, "copy").select("row", "first")


def similar_documents(docs: DataFrame, similarity: float = 0.8, width: int = 5, limit: int = 2000) -> DataFrame:
    """Rows (doc_id, component_id), one per row of ``docs(doc_id, text)``: the groups of ``similar_rows``, by their least doc_id (null if it has none)."""
    return similar_rows(docs, similarity, width, limit).select(F.col("row.id").alias("doc_id"), F.col("first.id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """``docs`` with one row of each group of ``similar_rows``: that of the least doc_id (null last), and of several those of the least digest.

    So a document goes only if it has a similar one, under whatever doc_id, and a group never loses its last row. Rows with a null doc_id are judged by
    their texts. Of rows with equal doc_id and text one stays, the first by its other columns' JSON. All columns come back as they are, whatever their names;
    an empty table gives an empty result.
    """
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("kept"), _row_of(docs["doc_id"], docs["text"]).alias("row"))
    found = keep(similar_rows(docs.select("doc_id", "text"), similarity, width), "groups")
    extra = found.where("row <> first").select(F.col("row").alias("extra")).distinct()
    twice = keep(found.where("row = first").groupBy("row").count().where("count > 1").select(F.col("row").alias("twice")), "repeated")
    match = lambda name: F.col("row.id").eqNullSafe(F.col(f"{name}.id")) & (F.col("row.digest") == F.col(f"{name}.digest"))
    left = rows.join(extra, match("extra"), "left_anti")
    if twice.isEmpty():
        return left.select("kept.*")
    once = left.join(twice, match("twice"), "left_semi").groupBy("row").agg(F.min_by("kept", F.to_json("kept")).alias("kept"))
    return left.join(twice, match("twice"), "left_anti").select("kept.*").unionByName(once.select("kept.*"))
