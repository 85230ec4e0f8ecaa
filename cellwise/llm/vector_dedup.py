"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosines, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwise.llm.cells import to_cells, whole_cells
from cellwise.llm.components import components
from cellwise.llm.store import keep

SKETCH = 128


def usable(vector: Column) -> Column:
    """Not null, not all zero, and every component finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def sign_codes(vectors: np.ndarray, tables: int, bits: int, seed: int) -> np.ndarray:
    """One integer of ``bits`` signs per vector and table."""
    planes = np.random.default_rng([seed, vectors.shape[1]]).standard_normal((vectors.shape[1], tables * bits))
    signs = (vectors @ planes > 0).reshape(len(vectors), tables, bits)
    return (signs * (1 << np.arange(bits))).sum(2).astype("<i4")


def close_pairs(unit: np.ndarray, raw: np.ndarray, least: float, at: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j with i in [at, to) whose cosine in double precision is at least ``least``."""
    product = unit[at:to] @ unit[at:].T
    i, j = np.nonzero(np.triu(product >= least - 1e-9, 1))
    edge = np.flatnonzero(product[i, j] < least + 1e-9)
    if len(edge):  # so near the threshold that rounding decides: by the plain formula
        a, b = raw[at + i[edge]], raw[at + j[edge]]
        cosine = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
        good = np.ones(len(i), bool)
        good[edge] = cosine >= least
        i, j = i[good], j[good]
    return at + i, at + j


def tables_for(vectors: int, least: float, miss: float, in_bucket: int = 64) -> tuple[int, int]:
    """(tables, bits) so that a bucket holds some ``in_bucket`` unlike vectors, and a pair at the cosine ``least`` meets in no table with the chance ``miss``."""
    bits = min(30, max(4, math.ceil(math.log2(max(vectors, 1) / in_bucket))))
    agree = (1 - math.acos(least) / math.pi) ** bits
    return math.ceil(math.log(miss) / math.log(1 - agree)), bits


def sketch_radius(least: float) -> int:
    """Bits of the sketch in which a pair at that cosine differs at most, but once in a billion: six standard deviations."""
    share = math.acos(least) / math.pi
    return min(SKETCH, math.ceil(SKETCH * share + 6 * math.sqrt(SKETCH * share * (1 - share))))


def near_duplicates(vectors: DataFrame, least: float = 0.95, miss: float = 2e-4, limit: int = 4000, seed: int = 11) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one per row of ``vectors(vec_id, embedding)``.

    Pairs that agree in all signs of some table are compared exactly. The bits of a table grow with the number of vectors, so that buckets don't, and
    the tables with the bits, so that a pair at the cosine ``least`` is missed with the chance ``miss`` at any size. Buckets hold ids and a sketch of
    128 signs; where two sketches are near enough for such a cosine, and only there, the vectors are fetched. Equal vectors collapse before
    hashing and count as linked with each other; a bucket of more than ``limit`` vectors is dealt over cells in which each of its pairs
    still meets. A pair counts in the first table that has it. Vectors that are null, zero or hold null or non-finite components, and
    vectors of different lengths, link with nothing. Repeated rows are vectors of their own. A null vec_id stays null, is passed
    over as component_id where the component has another, and its row is kept if component_id is null. Other columns
    are ignored; an empty table gives an empty result.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding")
    good = rows.where(usable(F.col("embedding")))
    distinct = good.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    distinct = keep(distinct.withColumn("node", F.monotonically_increasing_id()), "vectors")
    tables, bits = tables_for(distinct.count(), least, miss)
    radius = sketch_radius(least)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.groupby(batch["embedding"].map(len)):
                x = np.stack(part["embedding"].to_numpy()).astype(float)
                x /= np.abs(x).max(1, keepdims=True)
                codes = sign_codes(x, tables, bits, seed)
                keys = codes + (np.int64(x.shape[1]) * tables + np.arange(tables)) * (1 << bits)
                sketch = sign_codes(x, SKETCH // 8, 8, seed + 1).astype(np.uint8)
                yield pd.DataFrame({"node": part["node"], "sketch": [s.tobytes() for s in sketch], "codes": [c.tobytes() for c in codes], "keys": list(keys)})

    def promising(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, bounds in whole_cells(batches):
            some = np.zeros(len(frame), bool)
            for k in np.flatnonzero(np.diff(bounds) > 1):
                cell = slice(bounds[k], bounds[k + 1])
                some[cell] = _near_another(frame.iloc[cell], radius)
            yield frame.loc[some, ["cell", "part", "home", "bucket", "node"]]

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, bounds in whole_cells(batches):
            for k in np.flatnonzero(np.diff(bounds) > 1):
                yield _links_of_cell(frame.iloc[bounds[k] : bounds[k + 1]], least, (int(frame["bucket"].iloc[bounds[k]]) >> bits) % tables)

    marked = distinct.select("node", "embedding").mapInPandas(hashed, "node long, sketch binary, codes binary, keys array<long>")
    signs = keep(marked, "signs")
    cells = to_cells(signs.select("node", "sketch", F.explode("keys").alias("bucket")), "node", limit)
    near = keep(cells.mapInPandas(promising, "cell long, part int, home boolean, bucket long, node long"), "promising")
    fetched = near.join(distinct.select("node", "n", "embedding"), "node").join(signs.select("node", "codes"), "node")
    whole = fetched.repartition("cell").sortWithinPartitions("cell")
    found = keep(whole.mapInPandas(compared, "a long, b long, links long"), "links")

    # nodes of the graph sort as their least vec_id does, so a component's root tells its id
    name = distinct.select("node", F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("id"), "node").alias("name"))
    edges = found.where("b IS NOT NULL").select("a", "b")
    edges = edges.join(name.select(F.col("node").alias("a"), F.col("name").alias("from")), "a").join(name.select(F.col("node").alias("b"), F.col("name").alias("to")), "b")
    linked = components(edges.select(F.col("from").alias("a"), F.col("to").alias("b"))).select("id.node", F.col("root.id").alias("reach"))
    counts = found.where("links IS NOT NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    nodes = distinct.join(linked, "node", "left").join(counts, "node", "left")
    nodes = nodes.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("reach", "least").alias("reach"), F.lit(True).alias("there"))
    out = rows.join(nodes, "embedding", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("there"), F.col("reach")).otherwise(F.col("vec_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _near_another(cell: pd.DataFrame, radius: int) -> np.ndarray:
    """Which rows of a cell have a sketch within the radius of another's, of those pairs that this cell is to compare."""
    words = np.stack([np.frombuffer(s, "<u8") for s in cell["sketch"]])
    part, home = cell["part"].to_numpy(), cell["home"].to_numpy()
    some = np.zeros(len(cell), bool)
    for at in range(0, len(cell), 256):
        to = min(at + 256, len(cell))
        apart = np.zeros((to - at, len(cell) - at), np.uint16)
        for k in range(words.shape[1]):
            apart += np.bitwise_count(words[at:to, k, None] ^ words[None, at:, k])
        close = np.triu(apart <= radius, 1)
        close &= (part[at:to, None] != part[None, at:]) | home[at:to, None]
        some[at:to] |= close.any(1)
        some[at:] |= close.any(0)
    return some


def _links_of_cell(cell: pd.DataFrame, least: float, t: int) -> pd.DataFrame:
    """Of one cell of table t: rows (a, null, links) with the number of vectors that link to a, and (a, b, null) with links that connect."""
    raw = np.stack(cell["embedding"].to_numpy()).astype(float)
    raw = raw / np.exp2(np.floor(np.log2(np.abs(raw).max(1, keepdims=True))))  # by powers of two: exact, no overflow
    unit = raw / np.sqrt((raw * raw).sum(1, keepdims=True))
    node, n, part, home = (cell[c].to_numpy() for c in ("node", "n", "part", "home"))
    codes = np.stack([np.frombuffer(c, "<i4") for c in cell["codes"]])
    links, label, ends = np.zeros(len(node), np.int64), np.arange(len(node)), []
    for at in range(0, len(node), 256):
        i, j = close_pairs(unit, raw, least, at, min(at + 256, len(node)))
        own = (part[i] != part[j]) | home[i]
        i, j = i[own], j[own]
        for before in range(t):
            if not len(i):
                break
            new = codes[i, before] != codes[j, before]
            i, j = i[new], j[new]
        np.add.at(links, i, n[j])
        np.add.at(links, j, n[i])
        heads, first = np.unique(i, return_index=True)
        for x, near in zip(heads, np.split(j, first[1:])):
            others, where = np.unique(label[near], return_index=True)
            for other, y in zip(others, near[where]):
                if other != label[x]:
                    ends.append((node[x], node[y]))
                    label[label == other] = label[x]
    some = np.flatnonzero(links)
    ends = np.array(ends, np.int64).reshape(-1, 2)
    return pd.DataFrame({
        "a": np.concatenate([node[some], ends[:, 0]]),
        "b": pd.array([None] * len(some) + ends[:, 1].tolist(), "Int64"),
        "links": pd.array(links[some].tolist() + [None] * len(ends), "Int64"),
    })
