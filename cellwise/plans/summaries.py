"""Queries: one row or a few per case, as tables of results show them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwise.operators import area, battery, draws, exchange, information, resample, rho
from cellwise.operators.pairs import ensemble_mean
from cellwise.plans.inference import _AS_OBS, _FOUR, _PAIRS, BINS, _stats
from cellwise.plans.registry import GRID, E, query, select, sql_bin, sql_fd, sql_information
from cellwise.plans.statistics import _FD, _KNUTH_POINTS, _RHO, _SWEEP, _mean, _points_sql, _share, _sweep_sql, grid_of
from cellwise.sources import ensembles

_WEIGHTS = GRID.replace("FROM m", "FROM a")
_LOO_FD = _points_sql("[0.5, 1.0, 1.5]", "loo", "s", *[f"SELECT cell, {sql_fd(c)} AS b_{a} FROM p GROUP BY cell" for a, c in (("o", "o"), ("s", "s"), ("p", "loo"))])


def _at(c: str, alt: float) -> str:
    return _mean(f"(CASE WHEN alt = {alt} THEN {c} END)")


_TERMS = ["lam_o_f", "lam_o_loo", "lam_m"]
_TERM_SQL = ", ".join(f"{_at(c, 1.0)} AS {c}, {_at(c, 0.5)} AS {c}_half, {_at(c, 1.5)} AS {c}_more, quantile_cont(CASE WHEN alt = 1 THEN {c} END, 0.1) AS {c}_p10, quantile_cont(CASE WHEN alt = 1 THEN {c} END, 0.9) AS {c}_p90" for c in _TERMS)
_RATIO_SQL = ", ".join(f"{_at(f'ratio_{x}', 1.0)} AS ratio_{x}, {_share(f'ratio_{x} > 1', f'ratio_{x} IS NOT NULL AND alt = 1')} AS ratio_{x}_gt1" for x in ("f", "loo"))


@query(select(f"""WITH a AS ({_FD} SELECT cell, alt, lam_o AS lam_o_f, lam_m, CASE WHEN lam_m > 0 THEN lam_o / lam_m END AS ratio_f FROM pt), c AS ({_LOO_FD} SELECT cell, alt, lam_o AS lam_o_loo FROM pt), {_WEIGHTS}""",
  f"(SELECT {_TERM_SQL}, {_RATIO_SQL} FROM (SELECT *, CASE WHEN lam_m > 0 THEN lam_o_loo / lam_m END AS ratio_loo FROM a JOIN c USING (cell, alt)) JOIN g USING (cell))",
  [], [*[f"{c}{x}" for c in _TERMS for x in ("", "_half", "_more", "_p10", "_p90")], "ratio_f", "ratio_f_gt1", "ratio_loo", "ratio_loo_gt1"]))
def lambda_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, obs = ensembles.from_embeddings(spark, sf_dir)
    return area.lambda_terms(draws.points(members, obs), draws.points(members, obs, o_vs="loo"), grid_of(members).select("cell", "w"))


@query(select(_sweep_sql() + ", " + GRID, f"(SELECT b, {', '.join(f'{_mean(c)} AS {c}' for c in ('i_o', 'i_m', 'lam'))} FROM sw JOIN g USING (cell) GROUP BY b)", [], ["i_o", "i_m", "lam"], ["b"]))
def fixed_bin_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, obs = ensembles.from_embeddings(spark, sf_dir)
    return area.sweep_means(information.fixed_sweep(members, obs, _SWEEP), grid_of(members).select("cell", "w"))


_GAUSS = "-0.5 * log2(1 - pow(least({}, 0.999999), 2))"
_POOLED = {"rho_o": "rho_o", "rho_m": "rho_m", "rho_m_loo": "rho_m_loo", "ratio": "(rho_o / rho_m)", "gauss_i_o": f"({_GAUSS.format('rho_o')})", "gauss_i_m": f"({_GAUSS.format('rho_m')})"}


@query(select(E + ", " + GRID, f"(SELECT {', '.join(f'{_mean(v)} AS {k}' for k, v in _POOLED.items())}, {_share('rho_o > rho_m', 'rho_o IS NOT NULL')} AS area_ratio_gt1 FROM (SELECT cell, abs(corr(f, o)) AS rho_o, abs(corr(f, s)) AS rho_m, abs(corr(f, loo)) AS rho_m_loo FROM p GROUP BY cell) JOIN g USING (cell))",
  [], [*_POOLED, "area_ratio_gt1"]))
def pooled_rho_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, obs = ensembles.from_embeddings(spark, sf_dir)
    return area.pooled_means(rho.pooled(members, obs), grid_of(members).select("cell", "w"))


_AT_ONE = "SELECT cell, i_o AS {0}i_o1, i_m AS {0}i_m1, CASE WHEN lam_m > 0.02 THEN lam_o / lam_m END AS {0}lam1 FROM pt WHERE alt = 1"


@query(select(f"WITH a AS ({_FD} {_AT_ONE.format('')}), k AS ({_KNUTH_POINTS} {_AT_ONE.format('k_')}), {_WEIGHTS}",
  f"(SELECT {', '.join(f'{_mean(f"({c} - k_{c})")} AS d_{n}' for c, n in (('i_o1', 'i_o'), ('i_m1', 'i_m'), ('lam1', 'lam')))}, quantile_cont((i_o1 - k_i_o1) / i_o1, 0.5) AS med_rel_i_o FROM a JOIN k USING (cell) JOIN g USING (cell))",
  [], ["d_i_o", "d_i_m", "d_lam", "med_rel_i_o"]))
def rule_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, obs = ensembles.from_embeddings(spark, sf_dir)
    fd, knuth = draws.points(members, obs), draws.points(members, obs, rule="knuth", s="loo", loo_size="T", tiled=False)
    return area.rule_difference(information.band(fd), information.band(knuth), grid_of(members).select("cell", "w"))


@query(select(f"WITH a AS ({_FD} SELECT cell, lam_o, lam_m FROM pt WHERE alt = 1), k AS ({_AS_OBS} SELECT cell // 100 AS cell, cell % 100 AS truth, lam_o AS lam FROM pt), r AS ({E}{_RHO} SELECT cell, rho_o FROM ro), {_WEIGHTS}, "
  "c AS (SELECT a.*, lam_mean, w, rho_o > 0 AND lam_m > 0 AND lam_mean > 0 AS valid FROM a JOIN (SELECT cell, avg(lam) AS lam_mean FROM k GROUP BY cell) USING (cell) JOIN r USING (cell) JOIN g USING (cell)), "
  "v AS (SELECT source, w, valid, lam, CASE WHEN lam > 0 THEN lam_o / lam END AS rpc FROM c JOIN (SELECT cell, 'all' AS source, lam_m AS lam FROM a UNION ALL SELECT cell, 'mean', lam_mean FROM c UNION ALL SELECT cell, truth::VARCHAR, lam FROM k) USING (cell))",
  f"(SELECT source, sum(CASE WHEN valid THEN w ELSE 0 END) / sum(w) AS area_valid, {_share('rpc > 1', '(valid AND rpc IS NOT NULL)')} AS area_rpc_gt1, {_mean('(CASE WHEN valid THEN lam END)')} AS lam_m, {_mean('(CASE WHEN valid THEN rpc END)')} AS rpc FROM v GROUP BY source)",
  ["source"], ["area_valid", "area_rpc_gt1", "lam_m", "rpc"]))
def model_lambda_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, obs = ensembles.from_embeddings(spark, sf_dir)
    points = draws.points(members, obs, alts=(1.0,))
    return area.model_lambda_shares(points, draws.points_as_obs(members, alts=(1.0,)), rho.measures(members, obs).select("cell", "rho_o"), grid_of(members).select("cell", "w"))


@query(select(_PAIRS + ", " + GRID, f"(SELECT floor((lat + 90) / 30)::BIGINT AS band, {_share('i_mxy > 0.1', 'i_mxy IS NOT NULL')} AS share FROM {_stats('cd', 'cell')} JOIN g USING (cell) GROUP BY ALL)", [], ["share"], ["band"]))
def zonal_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = ensembles.from_embeddings(spark, sf_dir)[0]
    found = exchange.statistics(exchange.pairs_of(members, BINS), ["cell"]).select("cell", *_FOUR)
    return area.zonal_shares(found, grid_of(members).select("cell", "lat", "w"), F.col("i_mxy") > 0.1)


_LOO_KNUTH = _KNUTH_POINTS
_B_MEDIANS = ", ".join(f"floor(quantile_cont(CASE WHEN alt = 1 THEN b_{a} END, 0.5)) AS median_{a}, avg(CASE WHEN alt = 1 THEN (b_{a} = 1)::INT END) AS single_{a}, avg(CASE WHEN alt = 1 THEN (b_{a} >= least(200, {n}))::INT END) AS capped_{a}" for a, n in (("f", "9 * n"), ("o", "n"), ("s", "n")))
_ALT_MEANS = ", ".join(f"{_at(i, alt)} AS {i}_{name}" for i in ("i_o", "i_m") for alt, name in ((0.5, "half"), (1.0, "one"), (1.5, "more")))


def _binning_sql() -> str:
    """Both rules as relation pa(rule, cell, alt, ...), the others' mean as the signal of Freedman and Diaconis' rule as pl, bands as bd."""
    plain = "SELECT '{}' AS rule, cell, alt, b_f, b_o, b_s, i_o, i_m, lam_o, lam_m FROM pt"
    loo = _points_sql("[1.0]", "f", "loo", *[f"SELECT cell, {sql_fd(c)} AS b_{a} FROM p GROUP BY cell" for a, c in (("o", "o"), ("s", "loo"), ("p", "f"))])
    return f"""WITH a AS ({_FD} {plain.format('fd')}), k AS ({_LOO_KNUTH} {plain.format('knuth')}), l AS ({loo} {plain.format('fd')}), {_WEIGHTS}, nt AS (SELECT count(DISTINCT vec_id // 10) AS n FROM embeddings),
pa AS (SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM k) JOIN g USING (cell) CROSS JOIN nt), pl AS (SELECT *, CASE WHEN lam_m > 0.02 THEN lam_o / lam_m END AS r FROM (SELECT * FROM l UNION ALL SELECT * FROM k WHERE alt = 1) JOIN g USING (cell)),
bd AS (SELECT rule, cell, w, max(i_m) - min(i_m) AS d, max(CASE WHEN alt = 1 THEN i_m END) AS i_m1 FROM pa GROUP BY ALL),
r1 AS (SELECT rule, {_at("lam_o", 1.0)} AS lam_o, {_at("lam_m", 1.0)} AS lam_m, {_B_MEDIANS}, {_ALT_MEANS} FROM pa GROUP BY rule),
r2 AS (SELECT rule, quantile_cont(CASE WHEN i_m1 > 1e-12 THEN d / i_m1 END, 0.5) AS med_rel_d_i_m, {_share("d > i_m1", "i_m1 IS NOT NULL")} AS area_d_i_m_gt_i_m FROM bd GROUP BY rule),
r3 AS (SELECT rule, {_mean("i_m")} AS loo_i_m, {_mean("lam_m")} AS loo_lam_m, {_mean("r")} AS loo_lam, {_share("r > 1", "r IS NOT NULL")} AS loo_area_lam_gt1, floor(quantile_cont(b_s, 0.5)) AS loo_median_s FROM pl GROUP BY rule)"""


_BINNING = [
    "lam_o", "lam_m", *[f"{x}_{a}" for a in "fos" for x in ("single", "capped")], *[f"{i}_{name}" for i in ("i_o", "i_m") for name in ("half", "one", "more")],
    "med_rel_d_i_m", "area_d_i_m_gt_i_m", "loo_i_m", "loo_lam_m", "loo_lam", "loo_area_lam_gt1",
]


@query(select(_binning_sql(), "r1 JOIN r2 USING (rule) JOIN r3 USING (rule)", ["rule"], _BINNING, ["median_f", "median_o", "median_s", "loo_median_s"]))
def binning_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By Freedman and Diaconis' rule, and by Knuth's with the others' mean as the signal."""
    members, obs = ensembles.from_embeddings(spark, sf_dir)
    named = lambda points, rule: points.withColumn("rule", F.lit(rule))
    fd, loo = draws.points(members, obs), draws.points(members, obs, alts=(1.0,), s="loo")
    knuth = draws.points(members, obs, rule="knuth", s="loo", loo_size="T", tiled=False)
    points = named(fd, "fd").unionByName(named(knuth, "knuth"))
    size = members.agg(F.count_distinct("t").alias("n"), F.count_distinct("member").alias("k"))
    caps = size.select(F.explode(F.array(*map(F.lit, ("fd", "knuth")))).alias("rule"), "n", "k")
    caps = caps.select("rule", F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.least(F.lit(200), n).alias("cap")) for a, n in (("f", F.col("n") * F.col("k")), ("o", F.col("n")), ("s", F.col("n")))])).alias("x")).select("rule", "x.*")
    return area.binning_row(points, named(loo, "fd").unionByName(named(knuth, "knuth")), information.band(points, ["rule", "cell"]), grid_of(members).select("cell", "w"), caps, ["rule"])


_TILES = (1, 2, 3, 5, 8, 16, 33, 65, 129)
_TILED = E + f""", sr AS (SELECT cell, t, s AS x, o AS y FROM (SELECT cell, t, avg(f) AS s FROM m GROUP BY ALL) JOIN o USING (cell, t)), tl AS (SELECT UNNEST({list(_TILES)}) AS tiles),
rp AS (SELECT cell, tiles, x, y FROM sr CROSS JOIN tl JOIN range(0, 129) c(copy) ON copy < tiles), nb AS (SELECT cell, tiles, {sql_fd("x")} AS bx, {sql_fd("y")} AS bn, min(x) x0, max(x) x1, min(y) y0, max(y) y1 FROM rp GROUP BY ALL),
cd AS (SELECT cell, tiles, {sql_bin("x", "x0", "x1", "bx")} AS cx, {sql_bin("y", "y0", "y1", "bn")} AS cy FROM rp JOIN nb USING (cell, tiles)),
cf AS (SELECT rp.cell, rp.tiles, {sql_bin("x", "x0", "x1", "bx")} AS cx, 0 AS cy FROM rp JOIN nb ON nb.cell = rp.cell AND nb.tiles = 1)"""


@query(select(_TILED, f"(SELECT a.cell, a.tiles, bx AS bins_x, bn AS bins_y, a.h_x, b.h_x AS h_fixed, a.mi FROM {sql_information('cd', 'cell, tiles')} a JOIN {sql_information('cf', 'cell, tiles')} b USING (cell, tiles) JOIN nb USING (cell, tiles))", ["cell"], ["h_x", "h_fixed", "mi"], ["tiles", "bins_x", "bins_y"]))
def tiling_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, obs = ensembles.from_embeddings(spark, sf_dir)
    rows = ensemble_mean(members).join(obs, ["cell", "t"]).select("cell", "t", F.col("s").alias("x"), F.col("o").alias("y"))
    return battery.tiling(rows, _TILES)
