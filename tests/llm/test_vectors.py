import numpy as np
import pytest

from cellwise.llm import ann, vector_dedup

SCHEMA = "vec_id long, embedding array<float>, node string, label int"


def some(n=600, d=24, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d))
    for i in range(0, n // 2, 5):  # groups of copies, near copies and scaled ones
        x[i + 1] = x[i]
        x[i + 2] = x[i] * 3
        x[i + 3] = x[i] + 0.15 * rng.standard_normal(d)
        x[i + 4] = x[i] + 0.3 * rng.standard_normal(d)
    return x.astype(np.float32)


def odd(d=24):
    bad = [None, [0.0] * d, [float("nan")] + [1.0] * (d - 1), [float("inf")] + [1.0] * (d - 1), [None] + [1.0] * (d - 1), [], [1.0, 2.0]]
    return [(10_000 + i, v, "x", 1) for i, v in enumerate(bad)]


@pytest.mark.parametrize("limit", [4000, 5])
def test_links_against_all_pairs(spark, limit):
    x = some()
    rows = [(i, v.tolist(), "x", 1) for i, v in enumerate(x)] + odd()
    found = {r.vec_id: r for r in vector_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4), limit=limit).collect()}
    y = x.astype(float)
    cosine = (y @ y.T) / np.sqrt((y * y).sum(1)[:, None] * (y * y).sum(1)[None])
    linked = cosine >= 0.95
    np.fill_diagonal(linked, False)
    root = np.arange(len(x))
    for _ in range(len(x)):
        new = np.minimum(root, np.where(linked, root[None], len(x)).min(1))
        if (new == root).all():
            break
        root = new
    assert linked.sum() > 500
    for i in range(len(x)):
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (linked[i].sum(), root[i], root[i] == i)
    for i, *_ in odd():
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (0, i, True)
    assert len(found) == len(rows)


def test_dedup_of_nulls_repeats_and_nothing(spark):
    rows = [(None, [1.0, 0.0], "x", 1), (4, [1.0, 0.0], "x", 1), (4, [1.0, 0.0], "x", 1), (9, [0.0, 1.0], "x", 1), (None, None, "x", 1)]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = sorted(map(tuple, vector_dedup.near_duplicates(frame).collect()), key=str)
    assert found == sorted([(4, 2, 4, True), (4, 2, 4, True), (None, 2, 4, False), (9, 0, 9, True), (None, 0, None, True)], key=str)
    assert vector_dedup.near_duplicates(frame.limit(0)).count() == 0


def brute(x, ids, q, k):
    score = x.astype(float) @ x[q].astype(float)
    order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[q]][:k]
    return [(int(ids[j]), score[j]) for j in order]


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = some(3000, 24, 3) * rng.uniform(0.5, 2, (3000, 1)).astype(np.float32)
    x[100:160] = x[100]
    ids = np.arange(3000)
    rows = [(int(i), v.tolist(), "x", 1) for i, v in zip(ids, x)] + odd()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    index = ann.build_index(frame, shard_rows=1000)
    found = ann.search(index, frame.where(ann.is_query(frame["vec_id"], 20)), chunk=64).collect()
    assert found[0].asDict().keys() == {"query_id", "rank", "vec_id", "score"}
    hits = 0
    for q in range(0, 3000, 20):
        got = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in got] == list(range(1, 21)) and len({r.vec_id for r in got}) == 20 and q not in {r.vec_id for r in got}
        assert [(-r.score, r.vec_id) for r in got] == sorted((-r.score, r.vec_id) for r in got)
        for r in got:
            assert r.score == pytest.approx(float(x[q].astype(float) @ x[r.vec_id].astype(float)), rel=1e-12)
        hits += len({r.vec_id for r in got} & {i for i, _ in brute(x, ids, q, 20)})
    assert hits >= 0.95 * 20 * 150
    copies = sorted((r for r in found if r.query_id == 120), key=lambda r: r.rank)
    assert {r.query_id for r in found} == set(range(0, 3000, 20)) | {10_000 + i for i in ()}
    assert [r.vec_id for r in copies] == [i for i, _ in brute(x, ids, 120, 20)]


def test_search_of_few_and_nothing(spark):
    rows = [(0, [1.0, 0.0], "x", 1), (1, [0.5, 0.5], "x", 1), (2, [0.5, 0.5], "x", 1), (3, [-1.0, 0.0], "x", 1), (3, [-1.0, 0.0], "x", 1), (None, [9.0, 9.0], "x", 1)]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = ann.search(ann.build_index(frame), frame.where("vec_id = 0")).orderBy("rank").collect()
    assert [tuple(r) for r in found] == [(0, 1, 1, 0.5), (0, 2, 2, 0.5), (0, 3, 3, -1.0)]
    assert ann.search(ann.build_index(frame.limit(0)), frame).count() == 0
    assert ann.search(ann.build_index(frame), frame.limit(0)).count() == 0


def recall(spark, x, **how):
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{'float' if x.dtype == np.float32 else 'double'}>").repartition(3)
    found = ann.search(ann.build_index(frame, **how), frame.where(ann.is_query(frame["vec_id"], 20)))
    got, ids, hits, all_ = {}, np.arange(len(x)), 0, 0
    for r in found.collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    for q in range(0, len(x), 20):
        wanted = {i for i, _ in brute(x, ids, q, 20)}
        assert len(got[q]) == min(20, len(x) - 1)
        hits, all_ = hits + len(wanted & got[q]), all_ + len(wanted)
    return hits / all_


def test_norms_over_many_decades(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3000, 24))
    assert recall(spark, (x * 10.0 ** rng.uniform(-6, 6, (3000, 1))).astype(np.float32), shard_rows=500) >= 0.95
    one = x.astype(np.float32)
    one[77] *= 1e4
    assert recall(spark, one, shard_rows=500) >= 0.95
    one[78, 3], one[79] = 1e20, 1e-30
    assert recall(spark, one) >= 0.95
    x[5] *= 1e150
    x[6] *= 1e-150
    assert recall(spark, x[:800]) >= 0.95


def test_clustered_vectors_and_few(spark):
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((25, 24))
    x = (centres[rng.integers(0, 25, 3000)] + 0.05 * rng.standard_normal((3000, 24))).astype(np.float32)
    assert recall(spark, x, shard_rows=800) >= 0.95
    for n in (2, 15, 70):
        assert recall(spark, x[:n]) == 1.0


def test_every_node_is_reached():
    rng = np.random.default_rng(8)
    x = ann.to_distance_space(np.vstack([rng.standard_normal((300, 8)) * 0.01 + c for c in np.eye(8)]))
    graph, start = ann.build_graph(x, 4, 8, 1.2, 0)
    seen, front = {start}, [start]
    while front:
        front = [int(j) for i in front for j in graph[i] if j >= 0 and j not in seen and not seen.add(j)]
    assert len(seen) == len(x)


def test_tables_for_a_miss_rate():
    for n in (1, 500, 50_000, 10**9):
        tables, bits = vector_dedup.tables_for(n, 0.95, 2e-4)
        agree = (1 - np.arccos(0.95) / np.pi) ** bits
        assert (1 - agree) ** tables <= 2e-4 and n / 2**bits <= 64 or bits == 30
