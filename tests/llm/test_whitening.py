"""Whitening against the eigenvectors of the plain covariance."""

import math

import numpy as np
import pytest

from cellwise.llm import queries, whitening


def folder_of(frame, tmp_path) -> str:
    frame.write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def plain(vectors: list[list[float]], most: int = 8):
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for v in vectors], object)
    n, sums = len(x), x.sum(axis=0)
    centred = (x * n - sums).astype(float) / n
    values, units = np.linalg.eigh(centred.T @ centred / n)
    first = np.argsort(-values)[:most]
    return n, [int(((n * row - sums) ** 2).sum()) for row in x], values[first], units[:, first], centred, values.sum()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_the_query_equals_the_plain_eigenvectors(spark, sf):
    folder = f"/root/testdata/{sf}"
    given = sorted(spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect())
    n, deviations, values, units, centred, trace = plain([r.embedding for r in given])
    rows = queries.op12_jacobi_whitening(spark, folder).toPandas()
    assert len(rows) == 8 * n and set(rows["n"]) == {n} and rows["identity_error"].nunique() == 1 and rows["identity_error"][0] < 1e-9
    wide = rows.pivot(index="vec_id", columns="component", values="whitened").sort_index()
    expected = centred @ units / np.sqrt(values)
    sign = np.sign((wide.to_numpy() * expected).sum(axis=0))
    assert np.abs(wide.to_numpy() * sign - expected).max() < 1e-8
    first = rows[rows["component"] == 1].sort_values("vec_id")
    assert first["deviation"].tolist() == deviations
    np.testing.assert_allclose(rows.drop_duplicates("component").sort_values("component")["explained"], values / trace, rtol=1e-10)


def test_bad_vectors_go_and_equal_ones_have_no_components(spark, tmp_path):
    rng = np.random.default_rng(0)
    good = [(i, rng.normal(size=3).tolist(), "x") for i in range(40)] + [(None, [1.0, 2.0, 3.0], "y"), (5, [1.0, 2.0, 3.0], "y"), (5, [1.0, 2.0, 3.0], "y")]
    bad = [(91, None, "z"), (92, [1.0, None, 2.0], "z"), (93, [1.0, math.nan, 2.0], "z"), (94, [math.inf, 0.0, 0.0], "z"), (95, [], "z"), (96, [1e300, 0.0, 0.0], "z")]
    frame = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>, whitened string")
    rows = queries.op12_jacobi_whitening(spark, folder_of(frame, tmp_path)).toPandas()
    n, deviations, values, *_ = plain([v for _, v, _ in good])
    assert len(rows) == 3 * len(good) and set(rows["n"]) == {n} and rows["vec_id"].isna().sum() == 3
    assert sorted(rows[rows["component"] == 2]["deviation"]) == sorted(deviations)
    numbers = whitening.whole_numbers(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)] + [(9, [1.0])], "vec_id long, embedding array<float>"))
    models = whitening.fit(numbers)
    assert {k: (m.n, len(m.eigenvalues)) for k, m in models.items()} == {1: (1, 0), 2: (5, 0)}
    assert [(r.deviation, r.whitened) for r in whitening.whiten(numbers, models).collect()] == [(0, [])] * 6


def test_empty_table(spark, tmp_path):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert queries.op12_jacobi_whitening(spark, folder_of(frame, tmp_path)).count() == 0


def test_deviations_beyond_64_bits_are_exact(spark):
    values = [[1e12, -1e12], [3e12, 5.0], [-7e12, 2.5]]
    numbers = whitening.whole_numbers(spark.createDataFrame(list(enumerate(values)), "vec_id long, embedding array<double>"))
    _, deviations, *_ = plain(values)
    assert [int(r.deviation) for r in whitening.whiten(numbers, whitening.fit(numbers)).orderBy("vec_id").collect()] == deviations


@pytest.mark.parametrize("d, rank", [(1, 1), (2, 2), (7, 7), (12, 5), (40, 40)])
def test_cholesky_and_jacobi(d, rank):
    rng = np.random.default_rng(d)
    half = rng.normal(size=(d, rank)) * 10.0 ** rng.uniform(-3, 3, rank)
    v = half @ half.T
    factor, order = whitening.pivoted_cholesky(v)
    np.testing.assert_allclose(factor @ factor.T, v[np.ix_(order, order)], atol=1e-12 * np.abs(v).max())
    assert np.allclose(factor, np.tril(factor)) and (np.diff(np.abs(np.diag(factor))) <= 1e-12).all()
    turned = whitening.jacobi(factor)
    gram = turned.T @ turned
    norms = np.sqrt(np.diag(gram))
    assert np.abs(gram / np.outer(norms, norms) - np.eye(len(gram))).max() < 1e-13
    values, units = whitening.eigen(v, d)
    np.testing.assert_allclose(values[:rank], np.linalg.eigvalsh(v)[::-1][:rank], rtol=1e-6, atol=1e-13 * np.abs(v).max())
    np.testing.assert_allclose(v @ units, units * values, atol=1e-10 * values[0])
