"""Approximate nearest neighbours by inner product: a robust-pruned directed graph per shard, searched by beams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwise.llm.store import keep
from cellwise.llm.vector_dedup import usable

SEEN = 1 << 26  # nodes times queries in one search, a byte each


def to_distance_space(x: np.ndarray) -> np.ndarray:
    """One more coordinate makes all norms equal, so the largest inner product is the least Euclidean distance.

    In units of the largest norm: vectors of one shard have norms within a factor of two, so single precision does for the graph.
    """
    x = x / np.abs(x).max()
    x = x / np.sqrt((x * x).sum(1).max())
    return np.hstack([x, np.sqrt(np.maximum(1 - (x * x).sum(1), 0))[:, None]]).astype(np.float32)


def beam_search(x: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, width: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Ids and squared distances of the ``width`` best nodes met from ``start``, nearest first, for all queries at once (-1: none).

    Each round expands the ``step`` nearest nodes of every beam that aren't expanded yet, till none is left.
    """
    q, rows = len(queries), np.arange(len(queries))[:, None]
    norms = (x * x).sum(1)
    ids = np.full((q, width), -1, np.int32)
    far = np.full((q, width), np.inf, np.float32)
    opened = np.ones((q, width), bool)
    seen = np.zeros((q, len(x) + 1), bool)  # the last column stands for "none"
    seen[:, -1] = seen[:, start] = True
    ids[:, 0], opened[:, 0] = start, False
    far[:, 0] = norms[start] - 2 * queries @ x[start]
    live = np.arange(q)
    while len(live):
        chosen = np.argsort(np.where(opened[live], np.inf, far[live]), axis=1, kind="stable")[:, :step]
        fresh = ~np.take_along_axis(opened[live], chosen, 1)
        nodes = np.where(fresh, np.take_along_axis(ids[live], chosen, 1), -1)
        opened[live[:, None], chosen] = True
        near = np.where(nodes[:, :, None] >= 0, graph[nodes], -1).reshape(len(live), -1)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[live[:, None], near]] = -1
        seen[live[:, None], near] = True
        d = norms[near] - 2 * np.matmul(x[near], queries[live][:, :, None])[:, :, 0]
        d[near < 0] = np.inf
        both, apart = np.hstack([ids[live], near]), np.hstack([far[live], d])
        done = np.hstack([opened[live], near < 0])
        best = np.argpartition(apart, width - 1, axis=1)[:, :width]
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(apart, best, 1), axis=1, kind="stable"), 1)
        ids[live], far[live], opened[live] = (np.take_along_axis(a, best, 1) for a in (both, apart, done))
        opened[live] |= ids[live] < 0
        live = live[~opened[live].all(1)]
    return ids, far + (queries * queries).sum(1)[:, None]


def robust_prune(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each node up to ``degree`` of its candidates (-1: none): the nearest first, and after each choice none that the
    chosen one is nearer to, by the factor ``alpha``, than the node is. Rows are filled up with -1."""
    c = np.sort(candidates, axis=1)
    c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
    c[c == nodes[:, None]] = -1
    points = x[c]
    own = ((points - x[nodes][:, None]) ** 2).sum(2)
    own[c < 0] = np.inf
    norms = (points * points).sum(2)
    cross = np.maximum(norms[:, :, None] + norms[:, None, :] - 2 * points @ points.transpose(0, 2, 1), 0)
    out, rows = np.full((len(nodes), degree), -1, np.int64), np.arange(len(nodes))
    left = own.copy()
    for k in range(degree):
        pick = left.argmin(1)
        good = np.isfinite(left[rows, pick])
        if not good.any():
            break
        out[good, k] = c[rows, pick][good]
        left[(alpha * alpha * cross[rows, pick] <= own) & good[:, None]] = np.inf
        left[rows, pick] = np.inf
    return out


def build_graph(x: np.ndarray, degree: int, beam: int, alpha: float, seed: int, batch: int = 512) -> tuple[np.ndarray, int]:
    """Out-neighbours of every node (-1: none), and the node at which searches begin.

    From random edges: in random order, each node's beam search proposes neighbours, pruning keeps diverse ones, and edges
    back are added, pruned again where a node has too many.
    """
    rng, n = np.random.default_rng(seed), len(x)
    start = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    room = degree + degree // 2
    batch = max(16, min(batch, SEEN // n))
    graph = np.full((n, room), -1, np.int32)
    if n > 1:
        graph[:, : min(degree, n - 1) // 2 + 1] = (np.arange(n)[:, None] + rng.integers(1, n, (n, min(degree, n - 1) // 2 + 1))) % n
    order = rng.permutation(n)
    for at in range(0, n, batch):
        nodes = order[at : at + batch]
        met, _ = beam_search(x, graph, start, x[nodes], beam)
        chosen = robust_prune(x, nodes, np.hstack([met, graph[nodes]]), degree, alpha)
        graph[nodes, :degree], graph[nodes, degree:] = chosen, -1
        to, back = chosen.ravel(), np.repeat(nodes, degree)
        back, to = back[to >= 0], to[to >= 0]
        new = ~(graph[to] == back[:, None]).any(1)
        back, to = back[new], to[new]
        by = np.argsort(to, kind="stable")
        heads, first, count = np.unique(to[by], return_index=True, return_counts=True)
        slot = np.arange(len(by)) - np.repeat(first, count)
        used = (graph[heads] >= 0).sum(1)
        packed = -np.sort(-graph[heads], axis=1)  # the free places last
        full = used + count > room
        wide = np.full((len(heads), room + int(count.max(initial=0))), -1, np.int64)
        wide[:, :room] = packed
        wide[np.repeat(np.arange(len(heads)), count), np.repeat(used, count) + slot] = back[by]
        graph[heads[~full]] = wide[~full, :room]
        over, heads = wide[full], heads[full]
        for k in range(0, len(heads), 128):
            part = slice(k, k + 128)
            graph[heads[part], :degree] = robust_prune(x, heads[part], over[part], degree, alpha)
            graph[heads[part], degree:] = -1
    _connect(x, graph, start, beam)
    return graph, start


def _connect(x: np.ndarray, graph: np.ndarray, start: int, beam: int) -> None:
    """Add edges until every node can be reached from ``start``: to each that can't, from the nearest that can and has room (else in place of its last edge)."""
    reached = np.zeros(len(x), bool)
    reached[start] = True
    front = np.array([start])
    while True:
        while len(front):
            to = np.unique(graph[front])
            front = to[(to >= 0) & ~reached[to]]
            reached[front] = True
        lost = np.flatnonzero(~reached)
        if not len(lost):
            return
        node = lost[0]
        met = beam_search(x, graph, start, x[node : node + 1], beam)[0][0]
        met = met[met >= 0]
        free = (graph[met] < 0).any(1)
        if free.any():
            home = met[free.argmax()]
            graph[home, (graph[home] < 0).argmax()] = node
        else:  # a chain of nodes that each gave up an edge would come back here: the edge given up is kept as one of the new node's
            home = met[0]
            given, graph[home, -1] = graph[home, -1], node
            graph[node, (graph[node] < 0).argmax() if (graph[node] < 0).any() else -1] = given
        reached[node] = True
        front = np.array([node])


def _shard_row(dim: int, shard: int, frame: pd.DataFrame, degree: int, beam: int, alpha: float) -> pd.DataFrame:
    raw = np.stack(frame["embedding"].to_numpy())
    graph, start = build_graph(to_distance_space(raw.astype(float)), degree, beam, alpha, shard)
    sizes = frame["ids"].map(len).to_numpy(np.int64)
    ids = np.concatenate([np.asarray(i, np.int64) for i in frame["ids"]])
    return pd.DataFrame({"dim": [dim], "shard": [shard], "start": [start], "kind": [raw.dtype.str], "raw": [raw.tobytes()], "graph": [graph.astype("<i4").tobytes()], "sizes": [sizes.tobytes()], "ids": [ids.tobytes()]})


INDEX = "dim int, shard int, start int, kind string, raw binary, graph binary, sizes binary, ids binary"


def octave(vector: Column) -> Column:
    """The power of two of a vector's norm, from its components over the largest one, so that none is too large to square."""
    top = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    square = F.aggregate(vector, F.lit(0.0), lambda s, x: s + F.pow(x.cast("double") / top, F.lit(2.0)))
    return F.floor(F.log2(top) + F.log2(square) / 2).cast("int")


def build_index(vectors: DataFrame, k: int = 20, shard_rows: int = 8000, shard_bytes: int = 256_000_000, degree: int = 32, beam: int = 64, alpha: float = 1.2) -> DataFrame:
    """One row per shard, with its graph: every usable vector is indexed.

    A shard holds vectors of one length and of norms within a factor of two, so that no large one drowns the differences of small ones. Shards of a norm grow
    with the root of their vectors' number, from ``shard_rows`` on, which weighs the time to build one against the number that each query visits, until a shard's
    vectors take ``shard_bytes``: that is what a task holds. Equal vectors are one node that carries its k + 1 least vec_ids: no query can
    return others of them. Null vec_ids and vectors that are null, zero or hold null or non-finite components are left out; repeated rows
    count once; an empty table gives an empty index. Other columns are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding").where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    least = Window.partitionBy("embedding").orderBy("vec_id")
    ranked = rows.groupBy("vec_id", "embedding").agg(F.count("*").alias("copies")).withColumn("place", F.row_number().over(least)).where(F.col("place") <= k + 1)
    nodes = ranked.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = keep(nodes.withColumns({"dim": F.size("embedding"), "octave": octave(F.col("embedding"))}), "nodes")
    n = F.count("*")
    parts = F.ceil(F.greatest(F.sqrt(n / F.lit(shard_rows)), n * F.col("dim") * 8 / F.lit(shard_bytes))).cast("int").alias("parts")
    sizes = nodes.groupBy("dim", "octave").agg(parts)  # a row per length and power of two: some 2,000 of a length at most
    before = Window.partitionBy("dim").orderBy("octave").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("first", F.coalesce(F.sum("parts").over(before), F.lit(0)))
    dealt = nodes.join(F.broadcast(sizes), ["dim", "octave"]).withColumn("shard", (F.col("first") + F.pmod(F.xxhash64("embedding"), F.col("parts"))).cast("int"))

    def build(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return _shard_row(int(key[0]), int(key[1]), frame, degree, beam, alpha)

    return keep(dealt.groupBy("dim", "shard").applyInPandas(build, INDEX), "graphs")


def _search_shard(shard: pd.Series, queries: pd.DataFrame, k: int, beam: int) -> pd.DataFrame:
    raw = np.frombuffer(shard["raw"], shard["kind"]).reshape(-1, int(shard["dim"]))
    graph = np.frombuffer(shard["graph"], "<i4").reshape(len(raw), -1)
    sizes, ids = np.frombuffer(shard["sizes"], np.int64), np.frombuffer(shard["ids"], np.int64)
    begin = np.cumsum(sizes) - sizes
    x, out = to_distance_space(raw.astype(float)), []
    wanted = np.stack(queries["embedding"].to_numpy()).astype(float)
    unit = wanted / np.abs(wanted).max(1, keepdims=True)  # leaves the order of the candidates as it is
    unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
    spaced = np.hstack([unit, np.zeros((len(wanted), 1))]).astype(np.float32)
    step = max(16, min(256, SEEN // len(raw)))
    for at in range(0, len(wanted), step):
        part = slice(at, at + step)
        met, _ = beam_search(x, graph, int(shard["start"]), spaced[part], beam)
        score = np.einsum("qcd,qd->qc", raw[met].astype(float), wanted[part])
        score[met < 0] = -np.inf
        best = np.argsort(-score, axis=1, kind="stable")
        met, score = np.take_along_axis(met, best, 1), np.take_along_axis(score, best, 1)
        for q, row, s in zip(queries.iloc[part].itertuples(index=False), met, score):
            row, s = row[row >= 0], s[row >= 0]
            to = np.searchsorted(-s, -s[min(k, len(s) - 1)], "right")  # with all that tie with the last that can count
            row, s = row[:to], s[:to]
            every = np.concatenate([ids[b : b + m] for b, m in zip(begin[row], sizes[row])])
            scores = np.repeat(s, sizes[row])
            other = every != q.query_id
            every, scores = every[other], scores[other]
            first = np.lexsort((every, -scores))[:k]
            out.append((np.full(len(first), q.query_id), np.full(len(first), q.query), every[first], scores[first]))
    return pd.DataFrame(dict(zip(("query_id", "query", "vec_id", "score"), map(np.concatenate, zip(*out)))))


def search(index: DataFrame, queries: DataFrame, k: int = 20, beam: int = 96, chunk: int = 100_000) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each of ``queries(vec_id, embedding)`` the k nearest found in all shards.

    A beam search runs in every shard; its candidates are scored anew in double precision on the original vectors, and the
    best k of all shards stay, nearest first, ties to the smaller vec_id. Shards are sent once per ``chunk`` queries, which bounds a task's queries. A query meets all rows but those with its own vec_id,
    and only vectors of its length. Rows with a null vec_id and vectors that are null, zero or hold null or
    non-finite components take no part; a row that is repeated counts once; two vectors of one vec_id are two
    queries. Fewer candidates than k: all of them. Empty tables give an empty result.
    """
    rows = queries.select(F.col("vec_id").cast("long").alias("query_id"), "embedding")
    rows = rows.where(usable(F.col("embedding")) & F.col("query_id").isNotNull()).dropDuplicates(["query_id", "embedding"])
    rows = rows.withColumns({"dim": F.size("embedding"), "query": F.xxhash64("embedding")})
    chunks = rows.groupBy("dim").agg(F.ceil(F.count("*") / F.lit(chunk)).cast("int").alias("chunks"))
    rows = rows.join(F.broadcast(chunks), "dim").withColumn("chunk", F.pmod(F.xxhash64("query_id", F.lit(3)), F.col("chunks")).cast("int"))
    places = index.groupBy("dim").agg(F.max("shard").alias("last"))  # broadcast: a row per length of vectors
    asked = rows.join(F.broadcast(places), "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("last")))).drop("last")
    shards = index.join(F.broadcast(chunks), "dim").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")

    def find(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "query": [], "vec_id": [], "score": []})
        return _search_shard(left.iloc[0], right, k, beam)

    key = ["dim", "shard", "chunk"]
    found = shards.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(find, "query_id long, query long, vec_id long, score double")
    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def is_query(vec_id: Column, every: int) -> Column:
    """The stated query set: ids divisible by ``every``."""
    return F.pmod(vec_id, F.lit(every)) == 0
