"""Statistics that are done in the task of a cell, against plain loops."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellwise.operators import exchange, resample, rho


def frame_of(spark, cells):
    rows = [(c, m, t, None if np.isnan(v) else float(v)) for c, f in enumerate(cells) for m, row in enumerate(f) for t, v in enumerate(row)]
    return spark.createDataFrame(rows, "cell int, member int, t int, f double")


def ensembles(holes):
    r = np.random.default_rng(6)
    out = [r.normal(size=20) + r.normal(size=(n, 20)) * s for n, s in ((5, 1.0), (9, 0.2), (3, 2.0))]
    out.append(np.vstack([out[0][:4], np.full(20, 1 / 3)]))  # a member without spread
    if holes:
        for f in out:
            f[1, 3] = f[2, 7] = np.nan
            f[:, 11] = np.nan
    return out


@pytest.mark.parametrize("holes", [False, True])
def test_perfect_model_equals_ensembles_built_one_by_one(spark, holes):
    members = frame_of(spark, ensembles(holes))
    obs = spark.createDataFrame([(c, t, float(np.sin(t) + c)) for c in range(4) for t in range(1, 22)], "cell int, t int, o double")
    rest, truth = resample.leave_member_out(members)
    positive = F.when((F.col("rho_o") > 0) & (F.col("rho_m") > 0), F.col("rho_o") / F.col("rho_m"))
    null = {(r.cell, r.truth): r.x for r in rho.measures(rest, truth, ["cell", "truth"]).select("cell", "truth", positive.alias("x")).collect()}
    ref = {r.cell: r.x for r in rho.measures(members, obs).select("cell", positive.alias("x")).collect()}
    found = resample.perfect_model_rho(members, obs).collect()
    assert len(found) == len(null) == 22
    for r in found:
        for got, expected in ((r.null, null[r.cell, r.member]), (r.ref, ref[r.cell])):
            assert (got is None) == (expected is None) and (got is None or abs(got - expected) < 1e-9), r
    assert resample.perfect_model_rho(members.limit(0), obs.limit(0)).count() == 0


def plain_copula(f, source, picks):
    """Statistics of one cell by loops; source (member, t)."""
    loo = (f.sum(0) - f) / (len(f) - 1)

    def scores(x):
        flat = sorted(x.ravel().tolist())
        share = {v: (sum(a < v for a in flat) + flat.count(v) / 2) / len(flat) for v in set(flat)}
        return np.vectorize(lambda v: NormalDist().inv_cdf(share[v]))(x)

    zx, zy = (np.take_along_axis(scores(v), source, 0) for v in (loo, f))
    mi = lambda a, b: -0.5 * math.log2(1 - min(np.corrcoef(a.ravel(), b.ravel())[0, 1] ** 2, 1 - 1e-12))
    h = lambda a, b: math.log2(2 * math.pi * math.e) + 0.5 * math.log2(np.linalg.det(np.cov(a.ravel(), b.ravel(), bias=True)))
    own = np.mean([mi(a, b) for a, b in zip(zx, zy)])
    sized = np.mean([mi(zx[p, range(len(p))], zy[p, range(len(p))]) for p in picks])
    return {"i_cond": own, "i_pool": mi(zx, zy), "i_pool_t": sized, "delta": sized - own, "i_pool_minus_cond": mi(zx, zy) - own, "i_mxy": h(zx, zy) - np.mean([h(a, b) for a, b in zip(zx, zy)])}


def test_copula_null_equals_loops(spark):
    r = np.random.default_rng(2)
    cells = [r.normal(size=24) + r.normal(size=(5, 24)), np.round(r.normal(size=(5, 24)), 1)]
    members = frame_of(spark, cells)
    perms = exchange.label_permutations(spark, 3, 24, range(5), 4)
    picks = r.integers(0, 5, (7, 24))
    table = spark.createDataFrame([(k, t, int(picks[k, t])) for k in range(7) for t in range(24)], "k int, t int, member int")
    source = {0: np.tile(np.arange(5)[:, None], 24)}
    for p in perms.collect():
        source.setdefault(p.rep, np.zeros((5, 24), int))[p.member, p.t] = p.source
    found = exchange.test_statistics(members, perms, 3, picks=table, estimator="copula", at_once=130).collect()
    assert len(found) == 8
    for row in found:
        for name, value in plain_copula(cells[row.cell], source[row.rep], picks).items():
            assert abs(row[name] - value) < 1e-9, name
    both = exchange.copula_statistics(members).collect()
    for row in both:
        at_once = next(x for x in found if x.cell == row.cell and x.rep == 0)
        assert all(abs(row[c] - at_once[c]) < 1e-9 for c in ("i_cond", "i_pool", "i_mxy", "i_pool_minus_cond"))
    with pytest.raises(ValueError, match="estimator"):
        exchange.test_statistics(members, perms, 3, estimator="copula", detrended=True)


def test_copula_skips_missing_values_and_members_without_spread(spark):
    f = np.random.default_rng(3).normal(size=(4, 12))
    f[1, 2] = np.nan
    f[3] = 0.5
    found = exchange.test_statistics(frame_of(spark, [f]), exchange.rotations(spark, 2, 12, range(4), 1), 3, estimator="copula").collect()
    assert len(found) == 3 and all(r.i_pool is not None and not math.isnan(r.i_cond) for r in found)


def test_members_missing_at_a_time_take_no_part_in_edges(spark):
    r = np.random.default_rng(12)
    f = r.normal(size=(5, 11)) + r.normal(size=11)
    f[2:, 10] = np.nan  # a last time of two members
    members = frame_of(spark, [f]).where("f IS NOT NULL AND NOT isnan(f)")
    found = exchange.test_statistics(members, exchange.rotations(spark, 2, 11, range(5), 1), 3).where("rep = 0").first()
    plain = exchange.statistics(exchange.pairs_of(members, 3), ["cell"]).first()
    for c in ("i_cond", "i_pool", "i_mxy", "i_pool_minus_cond"):
        assert abs(found[c] - plain[c]) < 1e-9, c


def test_a_permutation_that_moves_nothing_gives_what_was_observed_without_lines_too(spark):
    r = np.random.default_rng(11)
    members = frame_of(spark, [r.normal(size=(9, 45)) + r.normal(size=45) + r.normal(size=(9, 1)) * np.arange(45) for _ in range(6)])
    perms = exchange.Rotations(9, 45, list(range(9)), 3)  # 404 steps among 405 values, so all three edges are values
    found = exchange.test_statistics(members, perms, 4, detrended=True).where("rep IN (0, 9)").collect()
    by = {(row.cell, row.rep): [row.i_cond, row.i_pool, row.i_mxy] for row in found}
    assert len(by) == 12
    for cell in range(6):
        np.testing.assert_allclose(by[cell, 9], by[cell, 0], atol=1e-12)
