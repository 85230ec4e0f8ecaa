import random

import pytest
import xxhash

from cellwise.llm import simhash
from cellwise.llm.components import components


def plain_fingerprint(text):
    words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def texts():
    rng = random.Random(3)
    vocabulary = [f"w{i}é" for i in range(400)]
    base = [" ".join(rng.choices(vocabulary, k=rng.randint(30, 300))) for _ in range(40)]
    near = []
    for text in base[:15]:
        for _ in range(3):
            words = text.split()
            words[rng.randrange(len(words))] = "changed"
            near.append(" ".join(words))
    return [None, "", " \t\n", "One", "one", "Two words", *base, *near, base[0], base[0], base[1].upper(), "x " * 50_000]


def test_fingerprint_is_the_plain_one():
    for text in texts()[:70]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)
    assert simhash.fingerprint("ÉA b c") == plain_fingerprint("Éa b c")


@pytest.mark.parametrize("limit", [20_000, 3])
def test_components_against_all_pairs(spark, limit):
    rows = [(i, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], "doc_id long, text string, bits string, cell string").repartition(3)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, limit=limit).collect()}
    bits = {i: plain_fingerprint(t) for i, t in rows}
    close = [(a, b) for a in bits for b in bits if a < b and (bits[a] ^ bits[b]).bit_count() <= 4]
    wanted = groups(close, bits)
    assert found == {i: (f"{bits[i]:016x}", wanted[i]) for i in bits}
    assert len(set(wanted.values())) < len(rows) - 20


def test_bk_tree_finds_all_within_the_radius():
    rng = random.Random(1)
    values = [rng.getrandbits(64) & 0x3FFFF for _ in range(500)]
    tree = simhash.BKTree(4)
    links = [(values[x], v) for v in values for x in tree.link(v)]
    for v in values[:50]:
        assert sorted(tree.search(v)) == sorted(x for x in values if (x ^ v).bit_count() <= 4)
    close = [(a, b) for a in set(values) for b in set(values) if a < b and (a ^ b).bit_count() <= 4]
    assert groups(links, values) == groups(close, values)


def test_empty_nulls_and_repeats(spark):
    schema = "doc_id long, text string"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (None, None)]
    found = sorted(map(tuple, simhash.near_duplicates(spark.createDataFrame(rows, schema)).select("doc_id", "component_id").collect()), key=str)
    assert found == [(5, 5), (5, 5), (None, 5), (None, None)]
    rows = [(1, "a b", 0), (2, "A  b", 0), (3, "c", 0), (3, "c", 0), (None, "a b", 0)]
    left = simhash.drop_near_duplicates(spark.createDataFrame(rows, schema + ", bits int"))
    assert left.columns == ["doc_id", "text", "bits"] and sorted(str(r.doc_id) for r in left.collect()) == ["1", "3"]  # a null id's row is a copy like any other


def test_rows_not_ids_are_dropped(spark):
    """Repeated and null doc_ids, clashing columns and empty tables: a row goes only if it has a like one, and one of a group stays."""
    schema = "doc_id long, text string, digest string, row int, copy int, node int"
    a, b, c = ("the first text of all", "quite another text that is here", "and a third one to go with")
    rows = [(1, a), (1, b), (2, c), (2, a), (None, b), (None, "only of a null id"), (None, "only of a null id"), (4, None), (5, " "), (6, c + " x"), (2, c)]
    docs = spark.createDataFrame([(*r, "d", 1, k, 3) for k, r in enumerate(rows)], schema).repartition(3)
    left = simhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    found = sorted(map(tuple, left.collect()), key=str)
    assert sorted((r[:2] for r in found), key=str) == sorted([(1, a), (1, b), (2, c), (None, "only of a null id"), (4, None), (6, c + " x")], key=str)
    assert (2, c, "d", 1, 10, 3) in found or (2, c, "d", 1, 2, 3) in found
    assert found == sorted(map(tuple, simhash.drop_near_duplicates(docs.repartition(2)).collect()), key=str)
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0
    groups_ = simhash.similar_documents(docs).collect()
    assert len(groups_) == len(rows)
    long = "w " * 30_000 + " ".join(f"x{i}" for i in range(3000))
    two = spark.createDataFrame([(1, long), (2, long + " end")], "doc_id long, text string")
    assert [r.doc_id for r in simhash.drop_near_duplicates(two).collect()] == [1]


def test_recall_on_the_given_documents(spark):
    """All pairs by brute force: no pair is joined without a chain of similar ones, and at least nine in ten of the similar ones are."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    sets = {r.doc_id: {tuple(r.text.encode().lower().split()[k : k + 5]) for k in range(max(1, len(r.text.split()) - 4))} for r in docs.collect()}
    by = {}
    for i, s in sets.items():
        for shingle in s:
            by.setdefault(shingle, []).append(i)
    shared = {}
    for ids in by.values():
        if len(ids) < 200:
            for x, i in enumerate(ids):
                for j in ids[:x]:
                    shared[i, j] = shared.get((i, j), 0) + 1
    alike = [(i, j) for (i, j), n in shared.items() if n / (len(sets[i]) + len(sets[j]) - n) >= 0.8]
    assert sum(found[i] == found[j] for i, j in alike) >= 0.9 * len(alike) > 20
    assert all(root == found[i] for i, root in groups(alike, sets).items() if found[i] != i or root == i)


def test_similar_documents_against_all_pairs(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    docs = [rng.choices(vocabulary, k=rng.randint(60, 400)) for _ in range(60)]
    for base in docs[:40]:
        changed = list(base)
        for _ in range(rng.randint(1, max(1, len(base) // 25))):
            changed[rng.randrange(len(base))] = "new"
        docs.append(changed)
    sets = [{tuple(d[i : i + 5]) for i in range(len(d) - 4)} for d in docs]
    alike = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(len(docs)) for j in range(i)}
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for (i, j), s in alike.items():
        if s >= 0.85:
            assert found[i] == found[j], s
        if s < 0.75 and {i, j} & set(range(40)):  # of a base text and its only near copy; one link could join more
            assert found[i] != found[j], s
    near = [found[i] == found[j] for (i, j), s in alike.items() if s >= 0.8]
    assert sum(near) >= 0.95 * len(near) > 10


def test_components_of_paths_stars_and_strings(spark):
    path = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1050)] + [(7, 7), (None, 3)]
    found = {r.id: r.root for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(201)}, **{i: 1000 for i in range(1000, 1050)}}
    assert {r.id: r.root for r in components(spark.createDataFrame([("b", "c"), ("c", "a")], "a string, b string")).collect()} == dict.fromkeys("abc", "a")
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    wanted = groups(pairs, {x for p in pairs for x in p})
    found = {r.id: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {x: wanted[x] for p in pairs if p[0] != p[1] for x in p}


def test_frames_of_whole_cells():
    import pandas as pd

    from cellwise.llm.cells import whole_cells

    cells = sorted([1] * 25 + [2] * 3 + [3] + [4] * 11)
    for size in (1, 2, 5, 40):
        batches = (pd.DataFrame({"cell": cells[i : i + size]}) for i in range(0, len(cells), size))
        got = [f["cell"].iloc[b[k] : b[k + 1]].tolist() for f, b in whole_cells(batches) for k in range(len(b) - 1)]
        assert got == [[1] * 25, [2] * 3, [3], [4] * 11]


def test_similar_documents_by_their_whole_sets(spark):
    """Long pairs just beside 0.8, which no sample of hashes tells apart, and the shortest pairs of exactly 0.8."""
    rows, alike = [], []
    for k in range(40):
        tail = 142 if k % 2 else 130  # of 1,400 shingles, those that the other text changes: 0.798 or 0.818
        words = [f"w{k}x{i}" for i in range(1404)]
        other = words[: 1404 - tail - 15] + [f"v{k}x{i}" for i in range(tail + 15)]
        sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (words, other)]
        alike.append(len(sets[0] & sets[1]) / len(sets[0] | sets[1]))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    assert min(alike) < 0.8 < max(alike) and all(abs(s - 0.8) < 0.03 for s in alike)
    for k in range(40, 140):
        words = [f"w{k}x{i}" for i in range(9)]
        rows += [(2 * k, " ".join(words[:8])), (2 * k + 1, " ".join(words))]
        alike.append(0.8)
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    joined = [found[2 * k + 1] == 2 * k for k in range(140)]
    assert not any(j for j, s in zip(joined, alike) if s < 0.8)
    close = [j for j, s in zip(joined, alike) if s >= 0.8]
    assert sum(close) >= 0.98 * len(close)  # but one in 300 shares a shard
    assert len({found[2 * k] for k in range(140)}) == 140


def test_radius_of_few_and_many_shingles():
    assert abs(simhash.few_share(0.8) - 3 / 16) < 1e-12 and simhash.radius_of(0.8) >= 79
    a, b = (simhash.shingle_set(" ".join(f"w{i}" for i in range(n))) for n in (8, 9))
    assert simhash.jaccard(a, b) == 0.8 == simhash.jaccard(b, a, 0.8) and simhash.jaccard(a[:3], b, 0.8) == 0
