import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellwise.functions import scalar, special
from cellwise.operators import area, battery, exchange, information, neighbours, pairs, prepare, resample, rho
from cellwise.sources import synthetic


def cube(n=7, times=40, cells=3, seed=0, missing=True):
    rng = np.random.default_rng(seed)
    s = rng.standard_normal((times, cells))
    f, o = 0.7 * s + rng.standard_normal((n, times, cells)), s + 0.5 * rng.standard_normal((times, cells))
    if missing:
        f[1, 3, 0] = np.nan
    return f, o


def tables(spark, f, o=None):
    rows = [(c, n, t, None if np.isnan(f[n, t, c]) else float(f[n, t, c])) for n in range(f.shape[0]) for t in range(f.shape[1]) for c in range(f.shape[2])]
    members = spark.createDataFrame(rows, "cell int, member int, t int, f double")
    if o is None:
        return members
    return members, spark.createDataFrame([(c, t, float(o[t, c])) for t in range(o.shape[0]) for c in range(o.shape[1])], "cell int, t int, o double")


def by_cell(df, *columns):
    return {r["cell"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_special_functions(spark):
    xs = [0.5, 1.0, 1.5, 2.0, 7.5, 100.0, 12345.5]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(special.lgamma(F.col("x")), special.digamma(F.col("x"))).collect()
    for x, (a, b) in zip(xs, got):
        assert a == pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-12)
        assert b == pytest.approx((math.lgamma(x + 1e-5) - math.lgamma(x - 1e-5)) / 2e-5, rel=1e-4, abs=1e-6)
    assert got[1][1] == pytest.approx(-0.5772156649015329, abs=1e-13)
    ps = [1e-12, 1e-4, 0.02, 0.3, 0.5, 0.77, 0.999, 1 - 1e-9]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select(special.normal_quantile(F.col("p"))).collect()
    for p, (z,) in zip(ps, got):
        assert z == pytest.approx(NormalDist().inv_cdf(p), rel=1e-12, abs=1e-12)


def test_bins_are_numpys(spark):
    rng = np.random.default_rng(5)
    rows, wanted = [], []
    for k in range(60):
        x = np.round(rng.standard_normal(50), 1) if k % 3 else np.ones(5) * k
        m = int(rng.integers(1, 30))
        rows += [(k, i, float(v), float(x.min()), float(x.max()), m) for i, v in enumerate(x)]
        wanted.append(np.histogram(x, bins=m)[0])
    frame = spark.createDataFrame(rows, "k int, i int, x double, lo double, hi double, m int")
    found = frame.select("k", scalar.bin_of(F.col("x"), F.col("lo"), F.col("hi"), F.col("m")).alias("b")).groupBy("k", "b").count().collect()
    for k, counts in enumerate(wanted):
        got = np.zeros(len(counts), int)
        for r in found:
            if r["k"] == k:
                got[r["b"]] = r["count"]
        assert (got == counts).all()


def test_leave_one_out_skips_what_is_missing(spark):
    f, _ = cube()
    found = {(r.cell, r.member, r.t): r.loo for r in pairs.with_means(tables(spark, f)).collect()}
    for n in range(7):
        rest = np.nanmean(np.delete(f, n, 0), 0)
        for t in range(40):
            for c in range(3):
                assert found[c, n, t] == pytest.approx(rest[t, c], rel=1e-12)
    with pytest.raises(ValueError):
        pairs.require_complete(tables(spark, f))
    assert pairs.require_complete(tables(spark, cube(missing=False)[0])).count() == 840


def corr(a, b):
    ok = np.isfinite(a) & np.isfinite(b)
    return np.corrcoef(a[ok], b[ok])[0, 1]


def test_rho(spark):
    f, o = cube()
    members, obs = tables(spark, f, o)
    s, loo = np.nanmean(f, 0), np.array([np.nanmean(np.delete(f, n, 0), 0) for n in range(7)])
    found = by_cell(rho.measures(members, obs), "rho_o", "rho_m", "sd_ratio")
    zero, pooled = np.nan_to_num(f), by_cell(rho.pooled(members, obs), "rho_o", "rho_m", "rho_m_loo")
    for c in range(3):
        spread = np.std(s[:, c]) / np.mean(np.nanstd(f[:, :, c], 1))
        assert found[c] == pytest.approx((corr(s[:, c], o[:, c]), np.mean([corr(loo[n, :, c], f[n, :, c]) for n in range(7)]), spread))
        flat = zero[:, :, c].ravel()
        assert pooled[c] == pytest.approx((abs(corr(flat, np.tile(o[:, c], 7))), abs(corr(flat, np.tile(s[:, c], 7))), abs(corr(flat, loo[:, :, c].ravel()))))
    flat = spark.createDataFrame([(0, 1.0, 2.0), (0, 1.0, 3.0)], "cell int, x double, y double")
    assert rho.correlation(flat, "x", "y", ["cell"], "r").first()["r"] is None


def mi(x, y, bins):
    c = np.histogram2d(x, y, bins=bins)[0]
    p = c / c.sum()
    h = lambda q: -(q[q > 0] * np.log2(q[q > 0])).sum()
    return h(p.sum(1)) + h(p.sum(0)) - h(p)


def fd(x):
    q = np.subtract(*np.percentile(x, [75, 25]))
    return int(np.ptp(x) / (2 * q / len(x) ** (1 / 3)))


def knuth(x, most):
    best, at = -np.inf, 1
    for m in range(1, most + 1):
        c = np.histogram(x, bins=m)[0]
        score = len(x) * math.log(m) + math.lgamma(m / 2) - math.lgamma(len(x) + m / 2) - m * math.lgamma(0.5) + sum(math.lgamma(k + 0.5) for k in c)
        if score > best + 1e-9:
            best, at = score, m
    return at


@pytest.mark.parametrize("how", [{}, {"s": "loo", "o_vs": "loo", "tiled": False, "loo_size": "T"}, {"rule": "fixed", "fixed": 4}, {"rule": "knuth", "tiled": False, "s": "loo", "most": 20}])
def test_point_estimates(spark, how):
    f, o = cube()
    members, obs = tables(spark, f, o)
    found = {(r.cell, r.alt): r for r in information.point_estimates(members, obs, **how).collect()}
    zero, s, loo = np.nan_to_num(f), np.nanmean(f, 0), np.array([np.nanmean(np.delete(f, n, 0), 0) for n in range(7)])
    rule = {"fd": fd, "fixed": lambda x: 4, "knuth": lambda x: knuth(x, min(20, len(x)))}[how.get("rule", "fd")]
    for c in range(3):
        fj, oj, sj, lj = zero[:, :, c].ravel(), np.tile(o[:, c], 7), np.tile(s[:, c], 7), loo[:, :, c].ravel()
        tiled = how.get("tiled", True)
        l_axis = rule(loo[:, :, c].mean(0)) if how.get("loo_size") == "T" else rule(lj)
        b_f, b_o = rule(fj), rule(oj) if tiled else rule(o[:, c])
        b_s = l_axis if how.get("s") == "loo" else rule(sj) if tiled else rule(s[:, c])
        b_p = l_axis if how.get("o_vs") == "loo" else b_f
        for alt in (0.5, 1.0, 1.5):
            r = found[c, alt]
            up = lambda b: math.ceil(b * alt)
            assert (r.b_f, r.b_o, r.b_s, r.b_p) == (b_f, b_o, b_s, b_p)
            i_o = mi(oj, lj if how.get("o_vs") == "loo" else fj, (up(b_o), up(b_p)))
            i_m = mi(lj if how.get("s") == "loo" else sj, fj, (up(b_s), up(b_f)))
            assert (r.i_o, r.i_m) == pytest.approx((i_o, i_m), abs=1e-12)
            lam = math.sqrt(1 - 2 ** (-2 * max(i_m, 0)))
            assert r.lam_m == pytest.approx(lam, abs=1e-7)


def test_a_cell_without_spread_has_no_value(spark):
    f, o = cube(missing=False)
    o[:, 1] = 3.0
    found = information.point_estimates(*tables(spark, f, o), alts=(1.0,)).where("cell = 1").first()
    assert (found.b_o, found.i_o, found.lam) == (None, None, None)


def test_thesis_rule_is_one_more(spark):
    x = np.random.default_rng(2).standard_normal(97)
    rows = spark.createDataFrame([(0, float(v)) for v in x], "cell int, x double")
    now, then = (fn(rows, "x", ["cell"], 40).first()["bins"] for fn in (information.knuth_counts, information.thesis_knuth_counts))
    assert now == knuth(x, 40) and then == (knuth(x, 39) + 1 if knuth(x, 39) > 1 else 1)
    assert information.knuth_counts(spark.createDataFrame([(0, 1.0)] * 10, "cell int, x double"), "x", ["cell"], 20).first()["bins"] == knuth(np.ones(10), 10)


def test_scores_do_not_change_with_a_distortion(spark):
    f, o = cube(missing=False)
    how = {"s": "loo", "o_vs": "loo", "loo_size": "T", "tiled": False, "scores": True, "alts": (1.0,)}
    plain, bent = (by_cell(information.point_estimates(*tables(spark, f, x), **how), "lam_o") for x in (o, np.expm1(3 * o)))
    assert {c: v[0] for c, v in plain.items()} == pytest.approx({c: v[0] for c, v in bent.items()})
    rows = spark.createDataFrame([(0, 3.0), (0, -1.0), (0, 10.0), (0, 3.0), (0, None), (0, 0.5)], "cell int, x double")
    got = {r.x: r.z for r in information.normal_scores(rows, "x", ["cell"], "z").collect()}
    assert got[None] is None and got[3.0] == pytest.approx(NormalDist().inv_cdf((3.5 - 0.5) / 5)) and got[-1.0] == pytest.approx(NormalDist().inv_cdf(0.1))


def codes_of(v, bins):
    edges = np.quantile(v.ravel(), np.arange(1, bins) / bins)
    return (v[..., None] >= edges).sum(-1)


def plain_statistics(cx, cy, bins):
    def h(c):
        p = c[c > 0] / c.sum()
        return -(p * np.log2(p)).sum()

    def table(a, b):
        return np.bincount((a * bins + b).ravel(), minlength=bins * bins).reshape(bins, bins).astype(float)

    info = lambda c: h(c.sum(0)) + h(c.sum(1)) - h(c.ravel())
    own = [table(a, b) for a, b in zip(cx, cy)]
    pool = sum(own)
    cond = np.mean([info(c) for c in own])
    return cond, info(pool), h(pool.ravel()) - np.mean([h(c.ravel()) for c in own])


def test_exchangeability_and_its_null(spark):
    f, _ = cube(8, 40, 2, missing=False)
    members = tables(spark, f)
    perms = exchange.label_permutations(spark, 15, 40, list(range(8)), block=5, seed=3)
    tab = {(r.rep, r.t, r.member): r.source for r in perms.collect()}
    assert len(tab) == 15 * 40 * 8
    for rep in range(1, 16):
        for t in range(40):
            assert sorted(tab[rep, t, m] for m in range(8)) == list(range(8)) and tab[rep, t, 0] == tab[rep, t - t % 5, 0]
    tested = exchange.test_statistics(members, perms, 3)
    found = {(r.cell, r.rep): r for r in tested.collect()}
    loo = (f.sum(0) - f) / 7
    wanted = {}
    for c in range(2):
        cx, cy = codes_of(loo[:, :, c], 3), codes_of(f[:, :, c], 3)
        assert np.bincount(cy.ravel()).tolist() == pytest.approx([107, 106, 107], abs=1)
        for rep in range(16):
            px, py = cx.copy(), cy.copy()
            if rep:
                for t in range(40):
                    order = [tab[rep, t, m] for m in range(8)]
                    px[:, t], py[:, t] = cx[order, t], cy[order, t]
            wanted[c, rep] = plain_statistics(px, py, 3)
            r = found[c, rep]
            assert (r.i_cond, r.i_pool, r.i_mxy) == pytest.approx(wanted[c, rep], abs=1e-12)
    sig = {(r.cell, r.stat): r for r in exchange.significance(tested).collect()}
    for c in range(2):
        null = np.array([wanted[c, rep][2] for rep in range(1, 16)])
        r = sig[c, "i_mxy"]
        assert (r.null_mean, r.null_sd) == pytest.approx((null.mean(), null.std(ddof=1)))
        assert r.p == pytest.approx((1 + (null >= wanted[c, 0][2] - 1e-12).sum()) / 16)
    grid = spark.createDataFrame([(0, 1.0), (1, 0.5)], "cell int, w double")
    field = exchange.field_significance(tested, grid, "i_mxy", 0.5).first()
    assert 0 < field.p_field <= 1 and field.area_obs == pytest.approx(sum(w for c, w in ((0, 1.0), (1, 0.5)) if sig[c, "i_mxy"].p <= 0.5) / 1.5)


def test_the_detrended_null_removes_lines_anew(spark):
    f, _ = cube(5, 20, 1, missing=False)
    f = f + np.linspace(0, 3, 20)[None, :, None] * np.arange(5)[:, None, None]
    perms = exchange.rotations(spark, 3, 20, list(range(5)))
    found = {r.rep: r for r in exchange.test_statistics(tables(spark, f), perms, 3, detrended=True).collect()}
    line = lambda v: v - np.array([np.polyval(np.polyfit(np.arange(20), x, 1), np.arange(20)) for x in v])
    y = f[:, :, 0]
    loo = lambda v: (v.sum(0) - v) / 4
    edges = [np.quantile(v.ravel(), [1 / 3, 2 / 3]) for v in (loo(line(y)), line(y))]
    code = lambda v, e: (v[..., None] >= e).sum(-1)
    for rep in range(4):
        if rep == 0:
            a, b = loo(line(y)), line(y)
        else:
            source = np.array([[(m + rep * (t + 1)) % 5 for t in range(20)] for m in range(5)])
            a, b = line(np.take_along_axis(loo(y), source, 0)), line(np.take_along_axis(y, source, 0))
        want = plain_statistics(code(a, edges[0]), code(b, edges[1]), 3)
        assert (found[rep].i_cond, found[rep].i_pool, found[rep].i_mxy) == pytest.approx(want, abs=1e-9)


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal(700)
    y = 0.8 * x + 0.6 * rng.standard_normal(700)
    frame = spark.createDataFrame([(0, float(a), float(b)) for a, b in zip(x, y)] + [(1, 0.0, 0.0)], "cell int, x double, y double")
    d = np.maximum(abs(x[:, None] - x), abs(y[:, None] - y))
    eps = np.sort(d, 1)[:, 4]
    nx, ny = [(abs(v[:, None] - v) < eps[:, None]).sum(1) - 1 for v in (x, y)]
    psi = lambda n: -0.5772156649015329 + sum(1 / k for k in range(1, n))
    want = psi(4) + psi(700) - np.mean([psi(a + 1) + psi(b + 1) for a, b in zip(nx, ny)])
    found = neighbours.ksg_information(frame, ["cell"]).collect()
    assert [(r.cell, pytest.approx(r.mi, abs=1e-10)) for r in found] == [(0, want)]
    assert abs(math.sqrt(1 - math.exp(-2 * want)) - 0.8) < 0.1


def test_bootstrap_and_perfect_model(spark):
    f, o = cube(6, 24, 2, missing=False)
    members, obs = tables(spark, f, o)
    slots, chosen = resample.numpy_draws(spark, "SLP", "s1961", 6, 24, 4, monthly=True)
    ts, ms = {}, {}
    for r in slots.collect():
        ts.setdefault(r.rep, {})[r.slot] = r.t
    for r in chosen.collect():
        ms.setdefault(r.rep, []).append(r.member)
    assert all(ts[k][i] % 12 == i % 12 for k in ts for i in ts[k]) and all(len(set(m)) == 3 for m in ms.values())
    found = {(r.cell, r.rep): r.rpc_rho for r in resample.bootstrap(members, obs, slots, chosen).collect()}

    def ratio(f, o):
        loo = (f.sum(0) - f) / (len(f) - 1)
        return corr(f.mean(0), o), np.mean([corr(loo[n], f[n]) for n in range(len(f))])

    for (c, k), got in found.items():
        t = [ts[k][i] for i in range(24)]
        a, b = ratio(f[ms[k]][:, t, c], o[t, c])
        assert got == pytest.approx(a / b)
    null = {(r.cell, r.member): (r.null, r.ref) for r in resample.perfect_model_rho(members, obs).collect()}
    for c in range(2):
        ref = ratio(f[:, :, c], o[:, c])
        for m in range(6):
            a, b = ratio(np.delete(f, m, 0)[:, :, c], f[m, :, c])
            assert null[c, m][0] == (pytest.approx(a / b) if a > 0 and b > 0 else None)
            assert null[c, m][1] == (pytest.approx(ref[0] / ref[1]) if min(ref) > 0 else None)
    classes = {r.cell: r for r in resample.intervals(spark.createDataFrame([(0, 2.0), (0, 3.0), (1, 0.5), (1, 2.0), (2, 0.1), (3, None)], "cell int, x double"), "x").collect()}
    assert [classes[c]["class"] for c in range(4)] == [1, 0, -1, None]


def test_preparation(spark):
    f, _ = cube(3, 30, 2)
    members = tables(spark, f)
    found = {(r.cell, r.member, r.t): r.f for r in prepare.detrend(members).collect()}
    for n in range(3):
        for c in range(2):
            ok = np.isfinite(f[n, :, c])
            t = np.arange(30)
            line = np.polyval(np.polyfit(t[ok], f[n, ok, c], 1), t)
            for k in range(30):
                assert found[c, n, k] == (pytest.approx(f[n, k, c] - line[k], abs=1e-12) if ok[k] else None)
    few = prepare.detrend(members.where("t < 2"), least=3)
    assert few.where("f IS NOT NULL").count() == 0
    lats, lons = [-60.0, -20.0, 20.0, 60.0], [0.0, 90.0, 180.0, 270.0]
    rows = spark.createDataFrame([(0, 0, la, lo, 5.0) for la in lats for lo in lons], "member int, t int, lat double, lon double, f double")
    assert [r.f for r in prepare.smooth_box(rows, lats, lons, (50.0, 100.0)).collect()] == pytest.approx([5.0] * 16)
    assert [r.f for r in prepare.to_grid(rows, lats, lons, [-90.0, 0.0, 75.0], [0.0, 350.0]).collect()] == pytest.approx([5.0] * 6)
    assert prepare.axis_weights([0.0, 1.0, 2.0], [0.25, 2.5]) == [(0.0, 0.25, 0.75), (1.0, 0.25, 0.25)]
    assert prepare.axis_weights([0.0, 1.0], [2.0], extrapolate=True) == [(0.0, 2.0, -1.0), (1.0, 2.0, 2.0)]
    assert prepare.box_for("TREFHT") == (15.0, 15.0) and prepare.box_for("SLP") == (11.25, 12.5)


def test_area_and_scalars(spark):
    frame = spark.createDataFrame([(0, 1.0, 1.0), (1, 0.5, 3.0), (2, 0.25, None)], "cell int, w double, x double")
    x, w = F.col("x"), F.col("w")
    got = frame.agg(area.mean(x, w), area.share(x > 2, w, x.isNotNull())).first()
    assert tuple(got) == pytest.approx((2.5 / 1.5, 0.5 / 1.5))
    one = spark.range(1)
    values = one.select(scalar.n_bins(F.lit(51)), scalar.n_bins(F.lit(8)), scalar.lambda_bits(F.lit(-0.1)), scalar.ratio(F.lit(0.5), F.lit(0.02)), scalar.month_label(F.lit(23530)), scalar.gauss_information(F.lit(0.8))).first()
    assert tuple(values) == (4, 3, 0.0, None, "1960-11", pytest.approx(0.7369655941662062))
    assert scalar.bin_choices(51) == (2, 4, 8) and scalar.parse_leads("2-4,13-60, 7") == [(2, 4), (13, 60), (7, 7)]
    with pytest.raises(ValueError):
        scalar.parse_leads("4-2")


def test_known_answers(spark):
    members, obs = synthetic.signal_and_noise(spark, 40, 10, 200, beta=1.0, seed=4)
    found = rho.measures(members, obs).agg(F.avg("rho_m"), F.avg("rho_o")).first()
    assert found[0] == pytest.approx(synthetic.equicorrelated_ratio(10, 0.5), abs=0.02)
    assert found[1] == pytest.approx(1 / math.sqrt(1.1 * 2), abs=0.02)
    series = synthetic.autoregressive(members.where("cell < 8"), 0.6, ["cell", "member"])
    lag = rho.lag_one(series).agg(F.avg("lag1")).first()[0]
    assert lag == pytest.approx(0.6, abs=0.06)
    alike = {r.stat: r.rejected for r in synthetic.rejection_rates(spark, 40, 6, 40, 19, 3, beta=0.8).collect()}
    unlike = {r.stat: r.rejected for r in synthetic.rejection_rates(spark, 40, 6, 40, 19, 3, beta=0.8, shift=[0, 0, 0, 2, 2, 2]).collect()}
    assert alike["i_mxy"] <= 0.2 and unlike["i_mxy"] >= 0.9


def ranks(v):
    order = np.argsort(np.argsort(v.ravel())) + 0.5
    return np.array([NormalDist().inv_cdf(x / v.size) for x in order]).reshape(v.shape)


def test_copula_and_member_terms(spark):
    f, _ = cube(6, 30, 2, missing=False)
    loo = (f.sum(0) - f) / 5
    found = by_cell(exchange.copula_statistics(tables(spark, f)), "i_cond", "i_pool", "i_mxy")
    terms = {(r.cell, r.member): r.term for r in exchange.member_terms(exchange.pairs_of(tables(spark, f), 3)).collect()}
    info = lambda a, b: -0.5 * math.log2(1 - np.corrcoef(a, b)[0, 1] ** 2)
    h = lambda a, b: math.log2(2 * math.pi * math.e) + 0.5 * math.log2(np.linalg.det(np.cov(a, b, ddof=0)))
    for c in range(2):
        x, y = ranks(loo[:, :, c]), ranks(f[:, :, c])
        want = (np.mean([info(a, b) for a, b in zip(x, y)]), info(x.ravel(), y.ravel()), h(x.ravel(), y.ravel()) - np.mean([h(a, b) for a, b in zip(x, y)]))
        assert found[c] == pytest.approx(want, abs=1e-9)
        mxy = plain_statistics(codes_of(loo[:, :, c], 3), codes_of(f[:, :, c], 3), 3)[2]
        assert np.mean([terms[c, m] for m in range(6)]) == pytest.approx(mxy)


def test_estimators_on_a_gaussian_pair(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal(300)
    y = 0.8 * x + 0.6 * rng.standard_normal(300)
    frame = spark.createDataFrame([(0, t, float(a), float(b)) for t, (a, b) in enumerate(zip(x, y))], "cell int, t int, x double, y double")
    found = {r.estimator: r.lam for r in battery.estimates(frame, ["cell"], (37, 101), 20).collect()}
    assert set(found) == set(battery.ESTIMATORS) and all(0.6 < v < 0.95 for v in found.values())
    table = np.zeros((7, 7))
    np.add.at(table, (codes_of(x, 7), codes_of(y, 7)), 1)
    p = table / 300
    part = lambda q: -(q[q > 0] * np.log2(q[q > 0])).sum()
    want = part(p.sum(0)) + part(p.sum(1)) - part(p)
    assert found["rank_bins"] == pytest.approx(math.sqrt(1 - 2 ** (-2 * want)))
    assert found["gauss_copula"] == pytest.approx(abs(np.corrcoef(ranks(x), ranks(y))[0, 1]), abs=1e-9)


def test_subsets(spark):
    frame = spark.createDataFrame([(m, 0.0) for m in range(10)], "member int, f double")
    members = lambda df: sorted(r.member for r in df.collect())
    for k in (1, 2, 4, 7, 30):
        assert members(battery.evenly_spaced(frame, k)) == sorted(set(np.round(np.linspace(0, 9, k)).astype(int)))
    assert sorted((r.size, r.member) for r in battery.prefix_sizes(frame, (2, 3)).collect()) == [(2, 0), (2, 1), (3, 0), (3, 1), (3, 2)]
    labels = spark.createDataFrame([(0, "B"), (1, "A"), (2, "B")], "member int, model string")
    assert [(r.model, r.members) for r in battery.models_in_order(labels).collect()] == [("B", 2), ("A", 1)]


def test_permuted_statistics_against_the_relabelled_rows(spark):
    """Counting a cell's permutations in one task gives what relabelling and counting all rows gives, with gaps and picks too."""
    rng = np.random.default_rng(11)
    rows = [(c, m, t, float(rng.standard_normal())) for c in range(2) for m in range(1, 6) for t in range(12) if (c, m, t) != (1, 2, 5)]
    members = spark.createDataFrame(rows, "cell int, member int, t int, f double")
    perms = exchange.label_permutations(spark, 4, 12, list(range(1, 6)), 3)
    picks = spark.createDataFrame([(k, t, (t * k) % 5 + 1) for k in range(1, 4) for t in range(12)], "k int, t int, member int")
    pairs = exchange.pairs_of(members, 3)
    moved = pairs.withColumnRenamed("member", "source").join(perms, ["t", "source"]).drop("source")
    wanted = exchange.statistics(pairs.withColumn("rep", F.lit(0)).unionByName(moved), ["cell", "rep"], picks)
    for at_once in (1, 10**6):
        found = exchange.test_statistics(members, perms, 3, picks=picks, at_once=at_once)
        a, b = (df.orderBy("cell", "rep").toPandas()[["cell", "rep", *exchange.STATS]].to_numpy(float) for df in (found, wanted))
        np.testing.assert_allclose(a, b, atol=1e-12)
    with pytest.raises(ValueError):
        exchange.test_statistics(members, perms, 3, most=10)
    orders = exchange.time_permutations(spark, 2, 11, 4).orderBy("rep", "t").toPandas()
    for rep, part in orders.groupby("rep"):
        assert sorted(part["source_t"]) == list(range(11)) == part["t"].tolist()
        assert rep > 0 or part["source_t"].tolist() == list(range(11))


def test_perfect_model_lambda_leaves_the_model_out(spark):
    rng = np.random.default_rng(12)
    signal = rng.standard_normal(40)
    rows = [(0, m, t, float(signal[t] + rng.standard_normal()), m % 2) for m in range(6) for t in range(40)]
    members = spark.createDataFrame(rows, "cell int, member int, t int, f double, model int")
    obs = spark.createDataFrame([(0, t, float(signal[t])) for t in range(40)], "cell int, t int, o double")
    found = {r.member: r for r in resample.perfect_model_lambda(members, obs).collect()}
    assert set(found) == set(range(6))
    for m, row in found.items():
        rest = members.where(f"model <> {m % 2}").drop("model")
        truth = members.where(f"member = {m}").select("cell", "t", F.col("f").alias("o"))
        null, ref = (information.point_estimates(rest, o, alts=(1.0,)).first()["lam"] for o in (truth, obs))
        assert (row["null"], row["ref"]) == (pytest.approx(null), pytest.approx(ref))
