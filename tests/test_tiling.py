"""Tiling by weights against repeated values; bins of the table of rules."""

import numpy as np
import pytest

from cellwise.operators import battery


def entropy(counts):
    p = counts[counts > 0] / counts.sum()
    return float(-(p * np.log2(p)).sum())


def fd(v):
    low, high = np.quantile(v, [0.25, 0.75])
    return int(np.ptp(v) / (2 * (high - low) / len(v) ** (1 / 3))) if high > low else None


def test_weights_equal_repeated_values(spark):
    r = np.random.default_rng(5)
    cells = {0: (x := r.normal(size=33), x + r.normal(size=33)), 1: (np.round(r.normal(size=40)), r.normal(size=40)), 2: (np.zeros(9), r.normal(size=9))}
    rows = [(c, t, float(a), float(b)) for c, (x, y) in cells.items() for t, (a, b) in enumerate(zip(x, y))] + [(0, 99, None, 1.0)]
    found = battery.tiling(spark.createDataFrame(rows, "cell int, t int, x double, y double"), (1, 2, 7, 40)).collect()
    assert len(found) == 12
    for got in found:
        x, y = (np.tile(v, got.tiles) for v in cells[got.cell])
        assert (got.bins_x, got.bins_y) == (fd(x), fd(y))
        own = fd(cells[got.cell][0])
        if own is None:
            assert got.h_x is got.h_fixed is got.mi is None
            continue
        joint = np.histogram2d(x, y, bins=(fd(x), fd(y)))[0]
        assert got.h_x == pytest.approx(entropy(np.histogram(x, fd(x))[0])) and got.h_fixed == pytest.approx(entropy(np.histogram(x, own)[0]))
        assert got.mi == pytest.approx(entropy(joint.sum(1)) + entropy(joint.sum(0)) - entropy(joint.ravel()), abs=1e-9)
    assert battery.tiling(spark.createDataFrame([], "cell int, t int, x double, y double"), (1, 2)).count() == 0
