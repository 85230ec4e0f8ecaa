"""Nearest-neighbour counts against all pairs, in one task and in blocks."""

from statistics import NormalDist

import numpy as np
import pytest

from cellwise.operators import neighbours


def plain(x, y, k):
    dx, dy = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
    reach = np.sort(np.maximum(dx, dy), axis=1)[:, k, None]
    return np.maximum((dx < reach).sum(1) - 1, 0), np.maximum((dy < reach).sum(1) - 1, 0)


def series(kind, n=2000):
    r = np.random.default_rng(3)
    x, y = r.normal(size=n), r.normal(size=n)
    return {
        "normal": (x, y), "near a line": (x, x + 0.01 * y), "ties": (np.round(x, 1), np.round(y, 1)), "heap": (np.where(x > 0, 0.0, x), y), "one point": (x * 0, y * 0), "flat": (x, y * 0),
        "heavy tails": (r.standard_cauchy(n), r.standard_cauchy(n)), "short": (x[:5], y[:5]), "decimals": (np.round(x, 2) * 0.1, np.round(y, 2) * 0.3), "clusters": (np.round(x) * 1e6 + x, np.round(y) * 1e6 + y),
    }[kind]


@pytest.mark.parametrize("kind", ["normal", "near a line", "ties", "heap", "one point", "flat", "heavy tails", "short", "decimals", "clusters"])
def test_counts_equal_all_pairs(kind):
    x, y = series(kind)
    for got, expected in zip(neighbours._counts(x, y, 4), plain(x, y, 4)):
        assert (got == expected).all()


def test_long_series_in_blocks_equal_all_pairs(spark):
    kinds = ["normal", "near a line", "ties", "heap", "heavy tails", "decimals", "clusters", "short"]
    rows = [(kind, float(a), float(b)) for kind in kinds for a, b in zip(*series(kind, 700))]
    rows += [("none", None, 1.0), ("few", 1.0, 2.0), ("normal", None, 0.0)]
    frame = spark.createDataFrame(rows, "cell string, x double, y double").repartition(6)
    got = {}
    for r in neighbours.neighbour_counts(frame, ["cell"], 4, block=150).collect():
        got.setdefault(r.cell, []).append((r.nx, r.ny))
    assert set(got) == set(kinds)
    for kind in kinds:
        assert sorted(got[kind]) == sorted(zip(*(c.tolist() for c in plain(*series(kind, 700), 4)))), kind


def test_information_of_a_long_gaussian_series(spark):
    r = np.random.default_rng(8)
    x, z = r.normal(size=30_000), r.normal(size=30_000)
    frame = spark.createDataFrame(list(zip(x.tolist(), (0.8 * x + 0.6 * z).tolist())), "x double, y double").selectExpr("1 AS cell", "x", "y")
    whole = neighbours.ksg_information(frame, ["cell"]).first().mi
    assert abs(whole + 0.5 * np.log(1 - 0.64)) < 0.02
    assert abs(neighbours.neighbour_counts(frame, ["cell"], block=4000).selectExpr("avg(nx + ny)").first()[0] - neighbours.neighbour_counts(frame, ["cell"]).selectExpr("avg(nx + ny)").first()[0]) < 1e-9


def odd_ensemble(spark):
    """Members of two cells with holes, ties, a doubled row, a short member, more members than count, unknown keys and times that only one side has."""
    r = np.random.default_rng(9)
    rows, seen = [], []
    for c in (0, 1):
        base = r.normal(size=70)
        for m in range(20 if c else 5):
            f = np.round(base + r.normal(size=70), 1 if m % 2 else 9)
            rows += [(c, m, t, None if (t + m) % 23 == 0 else float(f[t])) for t in range(2 if m == 3 else 70) if t != 40 or m == 1]
        seen += [(c, t, None if t == 5 else float(np.round(base[t % 70] + r.normal(), 1))) for t in range(3, 75)]
    rows += [(0, 2, 9, 0.5), (2, 0, 1, 1.0), (2, 1, 1, 2.0), (None, 1, 3, 1.0), (1, None, 6, 1.5)]
    return spark.createDataFrame(rows, "cell int, member int, t int, f double").repartition(5), spark.createDataFrame([*seen, (2, 1, 1.0), (0, None, 1.0), (None, 3, 2.0)], "cell int, t int, o double")


def plain_lambdas(members, obs, noise, most=16, k=4):
    """(lam_o, lam_m) of one cell by loops: members (member, t, f), obs {t: o}, noise(seed, series, t), order(member)."""
    psi = lambda n: sum(1 / i for i in range(1, n)) - 0.5772156649015329

    def score(values):
        return np.array([NormalDist().inv_cdf((sum(u < v for u in values) + values.count(v) / 2) / len(values)) for v in values])

    def information(points, series):
        points = [p for p in points if p[1] is not None and p[2] is not None]
        if len(points) <= k:
            return None
        x, y = (score([p[i] for p in points]) + [noise(i, series, p[0]) for p in points] for i in (1, 2))
        nx, ny = plain(x, y, k)
        return psi(k) + psi(len(points)) - np.mean([psi(a + 1) + psi(b + 1) for a, b in zip(nx.tolist(), ny.tolist())])

    at = {}
    for _, t, f in members:
        at.setdefault(t, []).extend([] if f is None else [f])
    mean = lambda t, own: (sum(at[t]) - own) / (len(at[t]) - 1) if own is not None and len(at[t]) > 1 else None
    i_o = information([(t, o, sum(at[t]) / len(at[t]) if at.get(t) else None) for t, o in obs], -1)
    chosen = sorted({m for m, _, _ in members if m is not None}, key=lambda m: (noise(16, m, None), m))[:most]
    each = [i for m in chosen if (i := information([(t, f, mean(t, f)) for of, t, f in members if of == m], m)) is not None]
    return [np.sqrt(1 - np.exp(-2 * i)) if i > 1e-12 else 0.0 for i in (i_o, np.mean(each))]


def test_cells_in_their_tasks_equal_loops(spark):
    members, obs = odd_ensemble(spark)
    found = {r.cell: r for r in neighbours.ksg_cells(members, obs).collect()}
    assert set(found) == {0, 1}
    keys = spark.range(4000).selectExpr("int(id div 2000) AS cell", "int(id div 80 % 25) - 1 AS series", "int(id % 80) AS t")
    hashed = {(r.cell, r.series, r.t): r for r in keys.selectExpr("*", *[f"(pmod(xxhash64({s}, cell, series, t), 1 << 20) / (1 << 20) - 0.5) * 1e-9 AS n{s}" for s in (1, 2)], "xxhash64(16, series) AS n16").collect()}
    for cell, r in found.items():
        noise = lambda seed, series, t, cell=cell: hashed[cell, series, t or 0][f"n{seed}"]
        expected = plain_lambdas([tuple(m)[1:] for m in members.where(f"cell = {cell}").collect()], [tuple(o)[1:] for o in obs.where(f"cell = {cell} AND t IS NOT NULL").collect()], noise)
        assert (r.lam_o, r.lam_m) == pytest.approx(expected, abs=1e-9) and r.lam == pytest.approx(expected[0] / expected[1], abs=1e-6)
    assert neighbours.ksg_cells(members, obs.limit(0)).where("lam_o IS NULL AND lam_m IS NOT NULL").count() == 2
    assert neighbours.ksg_cells(members.limit(0), obs.limit(0)).count() == 0


def test_the_query_brings_each_cell_together_once(spark, tmp_path):
    from cellwise.plans.catalogue import QUERIES

    spark.createDataFrame([(i, [float(i % 7), i * 0.5], 0) for i in range(80)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    plan = QUERIES["ksg_lambda"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "Window" not in plan
