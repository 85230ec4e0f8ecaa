"""Queries over all rows of their tables, however many times, suppliers, cells and bins there are."""

import math

import numpy as np
import pytest

import __spark_entry__ as entry
from cellwise.sources import ensembles


def run(spark, name, folder):
    return entry.queries()[name](spark, str(folder)).collect()


@pytest.fixture
def vectors(spark, tmp_path):
    """Writes embeddings of one component from rows (member, t, value) and gives their folder."""

    def write(rows):
        rows = [(10 * t + m, 0, [float(x)]) for m, t, x in rows]
        spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
        return tmp_path

    return write


def test_interpolation_over_the_whole_time_axis(spark, vectors):
    folder = vectors([(m, t, t * t + m) for m in (1, 2) for t in range(90) if t != 60])
    found = {(r.member, r.t): r.f for r in run(spark, "time_interpolation_whole", folder)}
    assert found == {(m, t + 0.25): pytest.approx(0.75 * t * t + 0.25 * (t + 1) ** 2 + m) for m in (1, 2) for t in range(89) if t not in (59, 60)}


def plain_block(pairs, least=20):
    """The three ways, by sets."""
    starts, members = {s for s, _ in pairs}, {m for _, m in pairs}
    full = lambda ss, mm: {s for s in ss if all((s, m) in pairs for m in mm)}
    whole = lambda ss, mm: {m for m in mm if all((s, m) in pairs for s in ss)}
    ways = [(full(starts, members), members), (starts, whole(starts, members))]
    s, m = starts, members
    while True:
        kept = whole(s, m)
        now = (full(s, kept), kept)
        if now == (s, m) or not all(now):
            ways.append(now)
            break
        s, m = now
    good = [w for w in ways if all(w) and len(w[0]) >= least] or [w for w in ways if all(w)]
    return max(good, key=lambda w: len(w[0]) * len(w[1]))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_blocks_of_all_suppliers(spark, sf):
    folder = f"/root/testdata/{sf}"
    rows = spark.read.parquet(f"{folder}/lineitem.parquet").selectExpr("l_suppkey AS s", "year(l_shipdate) * 12 + month(l_shipdate) - 1 AS t").distinct().collect()
    pairs = {(r.t, r.s % 10) for r in rows if (r.t * 7 + r.s % 10 * 5) % 41}
    starts, members = plain_block(pairs)
    found = run(spark, "largest_block", folder)
    assert {r.id for r in found if r.side == "start"} == starts and {r.id for r in found if r.side == "member"} == members
    assert 0 < len(starts) * len(members) < len(pairs)
    for name, held in (("dropped_starts", {(r.t, r.s) for r in rows}), ("dropped_starts_whole", pairs)):
        everyone = {m for _, m in held}
        common = {t for t in {t for t, _ in held} if all((t, m) in held for m in everyone)}
        wanted = {m: sum((t, m) in held and t not in common for t in {t for t, _ in held}) for m in everyone}
        assert {r.member: r.dropped for r in run(spark, name, folder)} == {m: n for m, n in wanted.items() if n}
        assert wanted


def test_all_cells_of_the_line_items(spark):
    folder = "/root/testdata/sf0.001"
    cells = {r.cell for r in spark.read.parquet(f"{folder}/lineitem.parquet").selectExpr("l_returnflag || l_linestatus AS cell").distinct().collect()}
    assert {r.cell for r in run(spark, "detrend_by_season_whole", folder)} == cells > {"RF", "AF"}
    seen = {tuple(r) for r in ensembles.from_lineitem(spark, folder).select("cell", "member", "t").collect()}
    members = {c: {m for k, m, _ in seen if k == c} for c in cells}
    wanted = {(c, t) for c, _, t in seen if all((c, m, t) in seen for m in members[c])}
    assert {(r.cell, r.t) for r in run(spark, "common_months_whole", folder)} == wanted and len({c for c, _ in wanted}) > 1


def test_knuth_counts_beyond_fifty(spark, vectors):
    """A comb of 80 narrow teeth: the best count by brute force is well over 50."""
    values = [(t % 80) + 0.001 * (t // 80) for t in range(480)]
    n = len(values)

    def score(m):
        counts = np.histogram(values, m)[0]
        return n * math.log(m) + math.lgamma(m / 2) - m * math.lgamma(0.5) - math.lgamma(n + m / 2) + sum(math.lgamma(c + 0.5) for c in counts)

    best = max(range(1, 201), key=lambda m: (round(score(m), 9), -m))
    assert best > 50
    found = run(spark, "knuth_bins", vectors([(m, t, x) for m in (0, 1) for t, x in enumerate(values)]))
    assert {r.axis: r.bins for r in found} == {"o": best, "s": best}
