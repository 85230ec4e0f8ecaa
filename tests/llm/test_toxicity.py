import random

import numpy as np
import pytest

from cellwise.llm import toxicity


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        text, bad = rng.choices(words, k=rng.randint(20, 200)), i % 5 == 0
        for _ in range(rng.randint(2, 6) if bad else 0):
            text.insert(rng.randrange(len(text)), rng.choice(["Vile,", "nasty!", f"grubb{rng.randint(0, 999)}"]))
        rows.append((i, " ".join(text), int(bad)))
    return rows


def test_the_likelihood_has_its_greatest_value_there():
    rng = np.random.default_rng(0)
    rows = [list(np.flatnonzero(rng.random(4) < 0.4)) for _ in range(800)]
    true = np.array([2.0, -1.0, 0.5, 3.0])
    noise = rng.logistic(size=800)
    grades = np.digitize(np.array([true[r].sum() for r in rows]) + noise, [1.0, 2.5, 4.0])
    weights, cuts = toxicity.fit_cumulative_link(rows, grades, 4, 4, penalty=0.0, rounds=1500)
    assert (np.diff(cuts) > 0).all()

    def likelihood(w, c):
        score = np.array([w[r].sum() for r in rows])
        c = np.concatenate([[-np.inf], c, [np.inf]])
        p = lambda k: 1 / (1 + np.exp(-(score - c[k])))
        return np.log(p(grades) - p(grades + 1)).sum()

    best = likelihood(weights, cuts)
    assert best >= likelihood(true, np.array([1.0, 2.5, 4.0]))
    for k in range(4):
        for step in (-0.05, 0.05):
            assert likelihood(weights + step * (np.arange(4) == k), cuts) < best
    assert abs(weights - true).max() < 0.6


def test_held_out_documents(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", "x") for i, t, _ in rows], "doc_id long, text string, toxic string, grade string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows if i % 2 == 0] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    found = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert sum(found[i].toxic == bool(y) for i, _, y in rows if i % 2) >= 0.98 * len(rows) / 2
    assert all(0 <= r.expected_severity <= 2 and r.grade in (0, 1, 2) for r in found.values())
    assert model.thresholds[0] < model.thresholds[1]
    left = toxicity.drop_toxic(docs, model)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, r in found.items() if not r.toxic}
    again = toxicity.fit(docs.repartition(7), labels.repartition(3))
    assert again.weights == pytest.approx(model.weights)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, None), (None, "a"), (1, ""), (2, "b " * 100_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for labels in (none, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int"), spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")):
        model = toxicity.fit(docs, labels)
        assert [r.toxic for r in toxicity.score(docs, model).collect()] == [False] * 4
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.drop_toxic(docs, model).count() == 4


def test_the_given_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.fit(docs, labels.where("doc_id % 2 = 0"))
    found = toxicity.score(docs, model).join(labels.where("doc_id % 2 = 1").withColumnRenamed("toxic", "label"), "doc_id").collect()
    clean = [r for r in found if r.label == 0]
    assert sum(r.toxic for r in clean) <= 0.02 * len(clean)
    bad = [r for r in found if r.label == 1]
    assert sum(r.toxic for r in bad) >= 0.6 * len(bad)


def test_the_query_against_brute_force(spark):
    """Every given document by the plain formula: each feature once, P(grade >= k) from the sum of weights less each threshold."""
    import math

    from cellwise.llm import queries

    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    assert model.weights and model.thresholds[0] < model.thresholds[1]
    found = {r.doc_id: r for r in queries.QUERIES["op6_toxicity"](spark, sf).collect()}
    rows = docs.collect()
    assert len(found) == len(rows)
    for r in rows:
        words = {w.lower().strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for w in (r.text or "").split()}
        used = {w for w in words if w in model.weights} | {w[:n] + "*" for w in words for n in (4, 5, 6) if len(w) >= n and w[:n] + "*" in model.weights}
        total = sum(model.weights[f] for f in sorted(used))
        reach = [1 / (1 + math.exp(-max(-40, min(40, total - t)))) for t in model.thresholds]
        shares = [1 - reach[0], reach[0] - reach[1], reach[1]]
        row = found[r.doc_id]
        assert row.expected_severity == pytest.approx(sum(reach), abs=1e-9) and row.toxic == (reach[0] >= 0.5)
        assert shares[row.grade] == pytest.approx(max(shares), abs=1e-9)
