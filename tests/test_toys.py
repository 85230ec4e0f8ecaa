"""Seven estimators on pairs of known lambda, against published medians of 500 draws, and closed forms."""

import math

import numpy as np
import pytest

from cellwise.operators import battery
from cellwise.sources import synthetic

#: Published medians and 5th and 95th percentiles of 500 draws: (case, estimator, n).
PUBLISHED = {
    ("independent", "knuth", 33): (0.000, 0.000, 0.858), ("independent", "knuth_scores_3", 33): (0.348, 0.171, 0.527), ("independent", "rank_bins", 33): (0.332, 0.130, 0.536),
    ("independent", "gauss_copula", 33): (0.121, 0.011, 0.348), ("gaussian", "knuth_scores_3", 33): (0.686, 0.535, 0.797), ("gaussian", "rank_bins", 33): (0.708, 0.547, 0.802),
    ("gaussian", "rank_bins_bc", 33): (0.655, 0.449, 0.770), ("gaussian", "gauss_copula", 33): (0.780, 0.643, 0.878), ("gaussian", "ksg_scores", 33): (0.760, 0.581, 0.858),
    ("gaussian", "ksg_raw", 33): (0.764, 0.592, 0.867), ("skewed", "ksg_raw", 33): (0.637, 0.409, 0.767), ("skewed", "gauss_copula", 33): (0.774, 0.642, 0.872),
    ("non-monotonic", "knuth_scores_3", 33): (0.626, 0.399, 0.733), ("non-monotonic", "rank_bins", 33): (0.565, 0.332, 0.704), ("non-monotonic", "rank_bins_bc", 33): (0.468, 0.000, 0.645),
}


def test_estimators_on_the_toys_have_the_published_spread(spark):
    found = {(r.case, r.estimator, r.n): r for r in synthetic.toy_study(spark, (33,), 40).collect()}
    assert len(found) == 4 * 7
    for key, (median, low, high) in PUBLISHED.items():
        r = found[key]
        width = max(0.02, high - low)
        assert abs(r.median - median) < 0.3 * width, (key, r.median)
        assert abs(r.p5 - low) < 0.5 * width and abs(r.p95 - high) < 0.5 * width, (key, r.p5, r.p95)


def test_exact_values():
    assert synthetic.parabola_lambda() == pytest.approx(0.825, abs=5e-4)
    assert synthetic.mixture_entropy([0.0], [1.0], 2.0) == pytest.approx(0.5 * math.log(2 * math.pi * math.e * 4), abs=1e-9)
    assert synthetic.mixture_entropy([-50.0, 50.0], [1, 3], 1.0) == pytest.approx(0.5 * math.log(2 * math.pi * math.e) - 0.25 * math.log(0.25) - 0.75 * math.log(0.75), abs=1e-6)
    assert synthetic.siegert_ratio(0.25, 1) == 1 and synthetic.siegert_ratio(0.25, 10**9) == pytest.approx(0.5)


def test_rank_bins_of_series_of_unlike_lengths(spark):
    r = np.random.default_rng(0)
    cells = {0: (np.round(r.normal(size=33), 1), r.normal(size=33)), 1: (r.normal(size=9), r.normal(size=9)), 2: (r.normal(size=130), np.round(r.normal(size=130)))}
    rows = [(c, t, float(a), float(b)) for c, (x, y) in cells.items() for t, (a, b) in enumerate(zip(x, y))]
    found = {r.cell: r.mi for r in battery.rank_information(spark.createDataFrame(rows, "cell int, t int, x double, y double"), ["cell"]).collect()}
    for c, (x, y) in cells.items():
        b = max(3, math.floor(len(x) ** (1 / 3) + 0.5))
        a, d = (np.searchsorted(np.quantile(v, np.arange(1, b) / b), v, "right") for v in (x, y))
        joint = np.zeros((b, b))
        np.add.at(joint, (a, d), 1)
        h = lambda p: -sum(q * math.log2(q) for q in (p / p.sum()).ravel() if q > 0)
        assert found[c] == pytest.approx(h(joint.sum(0)) + h(joint.sum(1)) - h(joint), abs=1e-9)
