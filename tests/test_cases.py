"""Cases of several models, result folders and synthetic designs, against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellwise.operators import information, neighbours, resample
from cellwise.sources import cases, catalog, synthetic


def files_and_values(spark, gap=None, twice=None):
    """Two members of one model with two files each, months 0 to 23."""
    files = [("m", n, f"{n}-{k}", 12 * k, 12 * k + 11) for n in (1, 2) for k in (0, 1)]
    values = [(f"{n}-{t // 12}", c, t, float(100 * n + t + c)) for n in (1, 2) for t in range(24) for c in (0, 1) if (n, t) != gap]
    values += [(f"{n}-{t // 12}", c, t, 0.0) for n, t in ([twice] if twice else []) for c in (0, 1)]
    return spark.createDataFrame(files, "model string, name int, title string, lo int, hi int"), spark.createDataFrame(values, "title string, cell int, t int, f double")


def windows(spark):
    return spark.createDataFrame([("m", 3, 1, 2, 3, 4), ("m", 3, 8, 12, 10, 14), ("m", 20, 1, 6, 20, 25)], "model string, init int, lead_from int, lead_to int, w_lo int, w_hi int")


def test_window_means_take_whole_windows_only(spark):
    found = lambda **k: {(r.name, r.lead_from, r.cell): r.f for r in cases.window_means(*files_and_values(spark, **k), windows(spark), ["model", "name"]).collect()}
    whole = {(n, a, c): 100 * n + t + c for n in (1, 2) for a, t in ((1, 3.5), (8, 12.0)) for c in (0, 1)}
    assert found() == whole  # across two files; the window beyond month 23 gives nothing
    assert found(gap=(1, 12)) == {k: v for k, v in whole.items() if k[:2] != (1, 8)}
    assert found(twice=(2, 4)) == {k: v for k, v in whole.items() if k[:2] != (2, 1)}
    files, values = files_and_values(spark)
    means = cases.window_means(files, values, windows(spark), ["model", "name"])
    with pytest.raises(ValueError, match="lack"):
        cases.require_windows(means, files.select("model", "name"), windows(spark), ["model", "name"])
    assert cases.require_windows(means, files.select("model", "name"), windows(spark).where("init < 20"), ["model", "name"]).count() == 8


def test_series_in_the_order_that_is_wanted(spark):
    files, values = files_and_values(spark)
    want = spark.createDataFrame([(0, 14), (1, 3)], "pos int, t int")
    rows = {(r.name, r.cell, r.t): r.f for r in cases.monthly_series(files, values, want, ["model", "name"]).collect()}
    assert rows == {(n, c, p): 100.0 * n + t + c for n in (1, 2) for c in (0, 1) for p, t in ((0, 14), (1, 3))}
    with pytest.raises(ValueError, match="lack"):
        cases.monthly_series(*files_and_values(spark, gap=(1, 3)), want, ["model", "name"])
    late = spark.createDataFrame([(0, 3), (1, 30)], "pos int, t int")
    assert cases.monthly_series(files, values, late, ["model", "name"]).count() == 0


def test_a_pool_has_common_years_and_the_reference_observations(spark):
    years = {"a": range(2000, 2006), "b": range(2001, 2008)}
    rows = [(m, n, y, 0, float((y - 2000) ** 2 + len(m) + (n == "y"))) for m, ys in years.items() for n in ("x", "y") for y in ys]
    obs = [(m, y, 0, float(y * y if m == "b" else -1)) for m, ys in years.items() for y in ys if (m, y) != ("b", 2003)]
    members, obs = spark.createDataFrame(rows, "model string, name string, year int, cell int, f double"), spark.createDataFrame(obs, "model string, year int, cell int, o double")
    inits = spark.createDataFrame([("a", 1), ("b", 11)], "model string, init_month int")
    f, o = cases.pooled(members, obs, inits, detrended=False)
    common = [2001, 2002, 2004, 2005]
    assert [(r.t, r.o) for r in o.orderBy("t").collect()] == [(i, float(y * y)) for i, y in enumerate(common)]
    assert {(r.model, r.member) for r in f.collect()} == {("a", 1), ("a", 2), ("b", 3), ("b", 4)} and f.count() == 16
    assert {r.model: r.dropped for r in cases.common_years(members, obs)[1].collect()} == {"a": 2, "b": 2}
    own = {(r.member, r.t): r.f for r in cases.pooled(members, obs, inits)[0].collect()}
    y = np.array([(v - 2000) ** 2 for v in common], float)
    assert [own[1, t] for t in range(4)] == pytest.approx(list(y - np.polyval(np.polyfit(range(4), y, 1), range(4))))


def test_a_decade_loses_each_models_own_year(spark):
    rows = [(m, n, 0, t, 10.0 * len(m) * (t % 12) + (t // 12) * n) for m in ("a", "bb") for n in (1, 2) for t in range(36)]
    members = spark.createDataFrame(rows, "model string, name int, cell int, t int, f double")
    obs = spark.createDataFrame([(0, t, float(t % 12)) for t in range(36)], "cell int, t int, o double")
    f, o = cases.decade(members, obs, detrended=False)
    assert {(r.model, r.t // 12, r.member % 2): r.f for r in f.collect()} == {(m, k, n % 2): k * n - 1.5 for m in ("a", "bb") for k in range(3) for n in (1, 2)}
    assert all(r.o == 0 for r in o.collect())
    base, _ = cases.decade(members, obs, anomalies="none", detrended=False)
    cases.require_aligned(f.where("model = 'a'"), base.where("model = 'a'"))
    swapped = base.where("model = 'a'").replace({1: 2, 2: 1}, subset=["member"])
    with pytest.raises(ValueError, match="line up"):
        cases.require_aligned(f.where("model = 'a'"), swapped)
    with pytest.raises(ValueError, match="anomalies"):
        cases.decade(members, obs, anomalies="year")


def test_names_of_cases(spark):
    assert cases.parse_case("cmip5") == cases.Case("cmip5")
    assert cases.parse_case("s1961moy") == cases.Case("decade", start=1961, anomalies="moy") and cases.parse_case("s1978").anomalies == "none"
    assert cases.parse_case("2-4") == cases.Case("window", lead="2-4") and cases.parse_case("CanESM5_12-14") == cases.Case("window", "CanESM5", lead="12-14")
    members, obs = spark.createDataFrame([("CanESM5", 1), ("MIROC6", 2)], "model string, member int"), spark.range(1)
    assert [r.member for r in cases.load("CanESM5_2-4", {"window": lambda case: (members, obs)})[0].collect()] == [1]


def test_labels_that_were_not_checked_are_refused(spark):
    rows, labels = spark.createDataFrame([(1, 0.5)], "member int, f double"), spark.createDataFrame([(1, "a")], "member int, model string")
    assert catalog.members_of_model(rows, labels, "a", 1).count() == 1
    with pytest.raises(ValueError, match="not checked"):
        catalog.members_of_model(rows, labels, "a", 1, verified=False)


def test_problems_of_a_set(spark):
    entries = spark.createDataFrame([("S/a/1", "s1", "a", "h1"), ("S/b/2", "s2", "a", None), ("T/a/3", "s3", "a", "h3"), ("S/a/4", "s4", "a", "old"), ("S/5", "s5", "", "h5")], "dest string, source string, section string, sha256 string")
    files = spark.createDataFrame([("S/a/1", 10, "h1"), ("S/b/2", 10, "h2"), ("S/a/4", 90_000_000, "h4"), ("S/5", 1, "h5"), ("S/a/6", 1, "h6")], "dest string, size long, sha256 string")
    sources = spark.createDataFrame([("s1", "h1"), ("s2", "h2"), ("s4", "other")], "source string, sha256 string")
    problems = lambda only=None: sorted((r.dest, r.problem) for r in catalog.set_problems(entries, files, sources, "S", only=only).collect())
    assert problems() == sorted([("S/b/2", "section"), ("S/b/2", "unrecorded"), ("T/a/3", "outside"), ("T/a/3", "missing"), ("S/a/4", "differs from source"), ("S/a/4", "changed"), ("S/a/4", "too large"), ("S/5", "source missing"), ("S/a/6", "orphan")])
    assert problems("a/1") == []
    with pytest.raises(ValueError, match="no entry"):
        problems("nowhere")
    assert {r.dest: r.sha256 for r in catalog.refreshed(entries, files, "S/").collect()} == {"S/a/1": "h1", "S/b/2": "h2", "T/a/3": "h3", "S/a/4": "h4", "S/5": "h5"}


def test_nearest_neighbour_bootstrap(spark):
    members, obs = synthetic.signal_and_noise(spark, 2, 6, 60, beta=1.0, sigma=0.5, sigma_obs=0.5, seed=3)
    slots, chosen = resample.modular_draws(spark, 60, list(range(6)), 3)
    found = {(r.cell, r.rep): r for r in resample.ksg_bootstrap(members, obs, slots, chosen).collect()}
    assert set(found) == {(c, k) for c in (0, 1) for k in (1, 2, 3)}
    f, o = resample.resampled(members.where("cell = 1"), obs.where("cell = 1"), slots.where("rep = 2"), chosen.where("rep = 2"))
    alone = neighbours.ksg_lambda(f, o, ["cell", "rep"]).first()
    assert alone.lam_o == pytest.approx(found[1, 2].lam_o) and alone.lam_m == pytest.approx(found[1, 2].lam_m)


def test_seeded_draws_are_numpys(spark):
    slots, chosen = resample.numpy_draws(spark, "SLP", "2-4", 6, 10, 3)
    rng = np.random.default_rng([2014, sum(map(ord, "SLP2-4"))])
    for rep in (1, 2, 3):
        t, picked = rng.integers(0, 10, 10), rng.choice(6, 3, replace=False)
        assert [r.t for r in slots.where(f"rep = {rep}").orderBy("slot").collect()] == list(t)
        assert {r.member for r in chosen.where(f"rep = {rep}").collect()} == set(picked.tolist())


def test_rejections_of_designs(spark):
    unlike = {"shift": [0, 0, 0, 2, 2, 2]}
    grid = synthetic.rejection_grid(spark, {"alike": {}, "persistent": {"phi": 0.5, "block": 6}, "lognormal": {"lognormal": True}, "unlike": unlike}, 300, 6, 48, 19, 3, beta=0.8)
    rows = {(r.design, r.stat): r for r in grid.collect()}
    for r in rows.values():
        k, z = round(r.rejected * r.n), 1.959963984540054
        middle, half = (k / r.n + z * z / (2 * r.n)) / (1 + z * z / r.n), z * math.sqrt(r.rejected * (1 - r.rejected) / r.n + z * z / (4 * r.n**2)) / (1 + z * z / r.n)
        assert (r.low, r.high) == (pytest.approx(max(0, middle - half)), pytest.approx(min(1, middle + half)))
    # labels by time are an exact null of white noise; blocks are one of a persistent noise only as far as its memory is shorter
    assert all(rows[d, "i_mxy"].low <= 0.05 for d in ("alike", "lognormal")) and rows["persistent", "i_mxy"].rejected < 0.15 and rows["unlike", "i_mxy"].rejected > 0.9


def test_equicorrelated_arrays(spark):
    rs = [0.0, 0.5, 0.9]
    arrays = synthetic.equicorrelated(spark, rs, 12, 1500, seed=2)
    found = {r.r: r for r in synthetic.equicorrelated_metrics(arrays).collect()}
    for r in rs:
        assert found[r].rho_2 == pytest.approx(synthetic.equicorrelated_ratio(12, r), abs=0.05)
        assert found[r].rho_1 == pytest.approx(math.sqrt((1 + 11 * r) / 12), abs=0.05)
    assert found[0.9].lambda_m == pytest.approx(math.sqrt((1 + 11 * 0.9) / 12), abs=0.05) and found[0.9].gamma_m > found[0.5].gamma_m
    for q in (0.2, 0.6, 0.9):
        assert synthetic.equicorrelated_ratio(12, synthetic.correlation_for(q, 12)) == pytest.approx(q)


@pytest.mark.parametrize("exponential", [False, True])
def test_shared_signal(spark, exponential):
    members, obs = synthetic.shared_signal(spark, [0.2, 0.5, 0.8], [0.0, 0.64], 4000, exponential=exponential)
    rows = members.join(obs, ["cell", "t"]).groupBy("cell", "member").agg({"f": "var_pop", "o": "var_pop"}).collect()
    assert all(r["var_pop(f)"] == pytest.approx(1, abs=0.1) for r in rows)
    corr = {(r.cell, r.member): r.c for r in members.join(obs, ["cell", "t"]).selectExpr("cell", "member", "f", "o").groupBy("cell", "member").agg(F.corr("f", "o").alias("c")).collect()}
    # a normal variable and its standardised exponential correlate by 1 / sqrt(e - 1)
    link = 1 / math.sqrt(math.e - 1) if exponential else 1.0
    for m, share in enumerate([0.2, 0.5, 0.8]):
        assert corr[0, m] == pytest.approx(0, abs=0.06) and corr[1, m] == pytest.approx(0.8 * math.sqrt(share) * link, abs=0.06)


def test_gap_of_definitions(spark):
    rows = synthetic.gap_grid(spark, [(6, 80)], [0.2, 0.9], 4, [7, 23, 41], most=12).collect()
    assert len(rows) == 8 and {(r.members, r.times, r.rho, r.draw) for r in rows} == {(6, 80, q, d) for q in (0.2, 0.9) for d in range(4)}
    mean = lambda q, c: np.mean([r[c] for r in rows if r.rho == q and r[c] is not None])
    assert mean(0.9, "pool") > mean(0.2, "pool") + 0.3 and mean(0.9, "pool") == pytest.approx(0.9, abs=0.12)


@pytest.mark.parametrize("parts", [1, 3, 1024])
def test_scores_of_large_groups(spark, parts):
    rng = np.random.default_rng(4)
    rows = [("a", i, float(x)) for i, x in enumerate(rng.integers(0, 9, 60))] + [("b", i, float(x)) for i, x in enumerate(rng.lognormal(0, 3, 60))]
    rows += [("a", 60, None), ("c", 0, 2.0), ("d", 0, None), (None, 0, 1.0), ("b", 61, -0.0), ("b", 62, 0.0)]
    table = spark.createDataFrame(rows, "cell string, id int, x double")
    scores = lambda df: {(r.cell, r.id): r.z for r in df.collect()}
    want = scores(information.normal_scores(table.where("cell IS NOT NULL"), "x", ["cell"], "z"))
    assert scores(information.spread_scores(table, "x", ["cell"], "z", parts)) == {**{k: v if v is None else pytest.approx(v, abs=1e-12) for k, v in want.items()}, (None, 0): None}
    assert information.spread_scores(table.limit(0), "x", ["cell"], "z").count() == 0


def test_runs_on_a_template(spark):
    run = lambda lats, lons, k: (spark.createDataFrame([(t, float(y), float(x), float(k * t + 2 * y - x)) for t in (0, 1) for y in lats for x in lons], "t int, lat double, lon double, f double"), lats, lons)
    found = cases.build_ensemble({"r1": run([0.0, 10.0, 20.0], [0.0, 30.0], 5), "r2": run([5.0, 25.0], [10.0, 20.0, 40.0], 7)}, [0.0, 15.0], [15.0, 35.0]).collect()
    rows = {(r.name, r.member, r.t, r.lat, r.lon): r.f for r in found}
    # r1 ends at 30 degrees east, r2 begins at 5 degrees north
    want = {("r1", 0, t, y, 15.0): 5 * t + 2 * y - 15 for t in (0, 1) for y in (0.0, 15.0)} | {("r2", 1, t, 15.0, x): 7 * t + 30 - x for t in (0, 1) for x in (15.0, 35.0)}
    assert rows == {k: pytest.approx(v) for k, v in want.items()}
