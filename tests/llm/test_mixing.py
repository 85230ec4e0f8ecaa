from fractions import Fraction

import pytest

from cellwise.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, copies int"


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, target, open_ = Fraction(3, 2) * sum(sizes.values()), {}, set(order)
    while open_:
        level = budget / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in open_}
        target |= {s: Fraction(2 * sizes[s]) for s in over}
        budget -= sum(2 * sizes[s] for s in over)
        open_ -= over
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_and_copies(spark, seed):
    import random

    rng = random.Random(seed)
    names = [None, "", "a", "B", "é", "z", "hot"][: 3 + seed]
    rows = [(i, "w " * rng.choice([0, 1, 5, 5, 30, 400]), "hot" if "hot" in names and i % 3 else rng.choice(names), "x", 1) for i in range(500)]
    rows += [(1000, None, "a", "x", 1), (None, "p q", "a", "x", 1), (3, "same", "a", "x", 1), (3, "same", "a", "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    assert sorted(map(str, found)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
    sizes, largest = {}, {}
    for _, text, source, *_ in rows:
        n = len((text or "").split())
        sizes[source] = sizes.get(source, 0) + n
        largest[source] = max(largest.get(source, 0), n)
    targets, taken = plain_targets(sizes), dict.fromkeys(sizes, 0)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(float(targets[r.source]), rel=1e-12)
        assert r.taken == r.copies * r.size <= 2 * r.size
        taken[r.source] += r.taken
    for source in sizes:
        assert abs(taken[source] - targets[source]) <= largest[source]
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    counts = {}
    for r in mixed.collect():
        counts[r.doc_id, r.source] = counts.get((r.doc_id, r.source), 0) + 1
    wanted = {}
    for r in found:
        if r.copies:
            wanted[r.doc_id, r.source] = wanted.get((r.doc_id, r.source), 0) + r.copies
    assert counts == wanted


def test_one_source_no_words_and_nothing(spark):
    one = mixing.mix(spark.createDataFrame([(i, "a b c", "s", "x", 1) for i in range(40)], SCHEMA)).collect()
    assert sum(r.taken for r in one) == 180 and {r.copies for r in one} == {1, 2}
    none = mixing.mix(spark.createDataFrame([(1, "", "s", "x", 1), (2, None, None, "x", 1)], SCHEMA)).collect()
    assert [(r.taken, r.target) for r in none] == [(0, 0.0)] * 2
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixing.mixed_documents(spark.createDataFrame([], SCHEMA)).count() == 0
