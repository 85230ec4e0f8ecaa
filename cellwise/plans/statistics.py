"""Queries: means, correlations, information and lambda of the ensembles in the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwise.functions.special import CENTRE, FAR, TAIL
from cellwise.operators import area, draws, information, neighbours, pairs, rho
from cellwise.plans.registry import GRID, E, L, query, select, sql_bin, sql_fd, sql_information, sql_lambda
from cellwise.sources import ensembles


def grid_of(members: DataFrame) -> DataFrame:
    return ensembles.with_grid(members.select("cell").distinct())


@query(select(E, "(SELECT cell, t, avg(f) AS s FROM m GROUP BY cell, t)", ["cell", "t"], ["s"]))
def ensemble_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.ensemble_mean(ensembles.from_embeddings(spark, sf_dir)[0])


@query(select(E, "ms", ["cell", "member", "t"], ["f", "s", "loo"]))
def loo_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.with_means(ensembles.from_embeddings(spark, sf_dir)[0]).select("cell", "member", "t", "f", "s", "loo")


def _poly(c: tuple[float, ...], x: str) -> str:
    return f"({c[0]:.17e} + {x} * {_poly(c[1:], x)})" if len(c) > 1 else f"({c[0]:.17e})"


def sql_quantile(p: str) -> str:
    """The normal quantile of a column ``p``."""
    part = lambda t, x: f"{_poly(t[0], x)} / {_poly(t[1], x)}"
    q, r = f"({p} - 0.5)", f"sqrt(-ln(least({p}, 1 - {p})))"
    return f"CASE WHEN abs({q}) <= 0.425 THEN {q} * {part(CENTRE, f'(0.180625 - {q} * {q})')} ELSE sign({q}) * CASE WHEN {r} <= 5 THEN {part(TAIL, f'({r} - 1.6)')} ELSE {part(FAR, f'({r} - 5)')} END END"


# every seventh month of a member is missing
_RAGGED = L + """, q AS (SELECT cell, member, t, CASE WHEN (t + member) % 7 <> 0 THEN f END AS f FROM l)"""


def _ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ensembles.from_lineitem(spark, sf_dir)
    return rows.withColumn("f", F.when((F.col("t") + F.col("member")) % 7 != 0, F.col("f")))


@query(select(_RAGGED, """(SELECT a.cell, a.member, a.t, (SELECT avg(b.f) FROM q b WHERE b.cell = a.cell AND b.t = a.t AND b.member <> a.member) AS loo FROM q a)""", ["cell", "member", "t"], ["loo"]))
def loo_mean_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.with_means(_ragged(spark, sf_dir)).select("cell", "member", "t", "loo")


@query(select(E, "(SELECT *, f - loo AS d FROM (SELECT a.cell, a.member, a.t, a.f, avg(b.f) AS loo FROM m a JOIN m b ON a.cell = b.cell AND a.t = b.t AND a.member % 3 <> b.member % 3 GROUP BY ALL))", ["cell", "member", "t"], ["loo"]))
def leave_model_out_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = ensembles.from_embeddings(spark, sf_dir)[0].withColumn("model", F.col("member") % 3)
    return pairs.with_other_models(members).select("cell", "member", "t", F.col("lmo").alias("loo"))


_RHO = """, ro AS (SELECT cell, corr(s, o) AS rho_o FROM (SELECT cell, t, avg(f) AS s FROM m GROUP BY ALL) JOIN o USING (cell, t) GROUP BY cell),
rk AS (SELECT cell, member, corr(loo, f) AS rho FROM ms GROUP BY ALL), rm AS (SELECT cell, avg(rho) AS rho_m FROM rk GROUP BY cell),
sd AS (SELECT cell, sd_s / sd_f AS sd_ratio FROM (SELECT cell, stddev_pop(s) AS sd_s FROM (SELECT cell, t, avg(f) AS s FROM m GROUP BY ALL) GROUP BY cell)
  JOIN (SELECT cell, avg(d) AS sd_f FROM (SELECT cell, member, stddev_pop(f) AS d FROM m GROUP BY ALL) GROUP BY cell) USING (cell))"""


@query(select(E + _RHO, "ro JOIN rm USING (cell) JOIN sd USING (cell)", ["cell"], ["rho_o", "rho_m", "sd_ratio"]))
def rho_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rho.measures(*ensembles.from_embeddings(spark, sf_dir))


@query(select(E, "(SELECT cell, abs(corr(f, o)) AS rho_o, abs(corr(f, s)) AS rho_m, abs(corr(f, loo)) AS rho_m_loo FROM p GROUP BY cell)", ["cell"], ["rho_o", "rho_m", "rho_m_loo"]))
def pooled_rho(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rho.pooled(*ensembles.from_embeddings(spark, sf_dir))


@query(select(E, """(SELECT cell, sqrt(vs / vf) AS by_variance, sqrt(vs) / df AS by_spread FROM (SELECT cell, var_pop(s) AS vs FROM (SELECT cell, t, avg(f) AS s FROM m GROUP BY ALL) GROUP BY cell)
  JOIN (SELECT cell, avg(v) AS vf, avg(sqrt(v)) AS df FROM (SELECT cell, member, var_pop(f) AS v FROM m GROUP BY ALL) GROUP BY cell) USING (cell))""", ["cell"], ["by_variance", "by_spread"]))
def rho_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rho.variance_ratios(ensembles.from_embeddings(spark, sf_dir)[0])


@query(select(E + _RHO, "rk", ["cell", "member"], ["rho"]))
def member_rho(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rho.member_rho(ensembles.from_embeddings(spark, sf_dir)[0])


@query(select(E + _RHO, "(SELECT cell, quantile_cont(rho, 0.05) AS low, quantile_cont(rho, 0.5) AS middle, quantile_cont(rho, 0.95) AS high, avg((rho_o > rho)::INT) AS above FROM rk JOIN ro USING (cell) GROUP BY cell)", ["cell"], ["low", "middle", "high", "above"]))
def member_rho_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rho.member_summary(*ensembles.from_embeddings(spark, sf_dir))


@query(select(E, """(SELECT cell, sum(d * b) / sum(d * d) AS lag1 FROM (SELECT cell, f - s AS d, lag(f - s) OVER (PARTITION BY cell, member ORDER BY t) AS b FROM ms) GROUP BY cell)""", ["cell"], ["lag1"]))
def lag_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rho.lag_one(ensembles.from_embeddings(spark, sf_dir)[0])


@query("""SELECT event_type AS cell, count(value)::BIGINT AS n, round(avg(value), 6) + 0.0 AS mean, round(stddev_pop(value), 6) + 0.0 AS sd,
  round(avg(pow((value - a) / d, 3)), 6) + 0.0 AS skewness, round(kurtosis_pop(value), 6) + 0.0 AS kurtosis
  FROM (SELECT event_type, value::DOUBLE AS value, avg(value::DOUBLE) OVER (PARTITION BY event_type) AS a, stddev_pop(value::DOUBLE) OVER (PARTITION BY event_type) AS d FROM events) GROUP BY event_type""")
def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ensembles.table(spark, sf_dir, "events").select(F.col("event_type").alias("cell"), F.col("value").cast("double").alias("f"))
    return rho.moments(rows, "f", ["cell"])


def _points_sql(alts: str, x_o: str, x_m: str, b_o: str, b_s: str, b_p: str, more: str = "", b_f: str = f"SELECT cell, {sql_fd('f')} AS b_f FROM p GROUP BY cell") -> str:
    """Point estimates: b_* are scalar subqueries by cell over p, or over ``more`` relations."""
    return E + more + f""", b AS ({b_f}), b2 AS ({b_o}), b3 AS ({b_s}), b4 AS ({b_p}),
bb AS (SELECT * FROM b JOIN b2 USING (cell) JOIN b3 USING (cell) JOIN b4 USING (cell) CROSS JOIN (SELECT UNNEST({alts}) AS alt)),
x AS (SELECT cell, min(f) f0, max(f) f1, min(o) o0, max(o) o1, min({x_m}) m0, max({x_m}) m1, min({x_o}) p0, max({x_o}) p1 FROM p GROUP BY cell),
j AS (SELECT p.*, bb.* EXCLUDE (cell), x.* EXCLUDE (cell), ceil(b_f * alt) nf, ceil(b_o * alt) no, ceil(b_s * alt) ns, ceil(b_p * alt) np FROM p JOIN bb USING (cell) JOIN x USING (cell)),
co AS (SELECT cell, alt, {sql_bin("o", "o0", "o1", "no")} AS cx, {sql_bin(x_o, "p0", "p1", "np")} AS cy FROM j),
cm AS (SELECT cell, alt, {sql_bin(x_m, "m0", "m1", "ns")} AS cx, {sql_bin("f", "f0", "f1", "nf")} AS cy FROM j),
pt AS (SELECT cell, alt, b_f, b_o, b_s, b_p, i_o, i_m, {sql_lambda("i_o")} AS lam_o, {sql_lambda("i_m")} AS lam_m, CASE WHEN {sql_lambda("i_m")} > 0 THEN {sql_lambda("i_o")} / {sql_lambda("i_m")} END AS lam
  FROM bb JOIN (SELECT cell, alt, mi AS i_o FROM {sql_information("co", "cell, alt")}) USING (cell, alt) JOIN (SELECT cell, alt, mi AS i_m FROM {sql_information("cm", "cell, alt")}) USING (cell, alt))"""


_FD = _points_sql("[0.5, 1.0, 1.5]", "f", "s", *[f"SELECT cell, {sql_fd(c)} AS b_{a} FROM p GROUP BY cell" for a, c in (("o", "o"), ("s", "s"), ("p", "f"))])
_ONCE = ", once AS (SELECT cell, t, min(o) AS o, avg(loo) AS loo FROM p GROUP BY cell, t)"
_LOO = _points_sql("[0.5, 1.0, 1.5]", "loo", "loo", *[f"SELECT cell, {sql_fd(c)} AS b_{a} FROM once GROUP BY cell" for a, c in (("o", "o"), ("s", "loo"), ("p", "loo"))], more=_ONCE)
_POINT = (["cell", "alt::DOUBLE AS alt"], ["i_o", "i_m", "lam_o", "lam_m", "lam"], ["b_f", "b_o", "b_s", "b_p"])


@query(select(_FD, "pt", *_POINT))
def point_lambda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draws.points(*ensembles.from_embeddings(spark, sf_dir))


@query(select(_LOO, "pt", *_POINT))
def point_lambda_loo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draws.points(*ensembles.from_embeddings(spark, sf_dir), s="loo", o_vs="loo", tiled=False, loo_size="T")


_BAND = _FD + """, bd AS (SELECT cell, max(CASE WHEN alt = 1 THEN i_o END) AS i_o1, max(CASE WHEN alt = 1 THEN i_m END) AS i_m1, max(CASE WHEN alt = 1 THEN r END) AS lam1,
  max(i_o) - min(i_o) AS d_i_o, max(i_m) - min(i_m) AS d_i_m, max(r) - min(r) AS d_lam, min(r) AS low, max(r) AS high FROM (SELECT *, CASE WHEN lam_m > 0.02 THEN lam_o / lam_m END AS r FROM pt) GROUP BY cell)"""


@query(select(_BAND, "bd", ["cell"], ["i_o1", "i_m1", "lam1", "d_i_o", "d_i_m", "d_lam", "low", "high"]))
def alt_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return information.band(draws.points(*ensembles.from_embeddings(spark, sf_dir)))


def _mean(x: str) -> str:
    return f"sum(w * {x}) / sum(CASE WHEN {x} IS NOT NULL THEN w END)"


def _share(c: str, v: str) -> str:
    return f"sum(CASE WHEN {v} AND {c} THEN w ELSE 0 END) / sum(CASE WHEN {v} THEN w END)"


@query(select(_BAND + ", " + GRID, f"""(SELECT {_mean("i_o1")} AS i_o, {_mean("i_m1")} AS i_m, {_mean("d_i_o")} AS d_i_o, {_mean("d_i_m")} AS d_i_m, quantile_cont(d_i_o / i_o1, 0.5) AS med_rel_d_i_o,
  {_share("d_i_o > i_o1", "i_o1 IS NOT NULL")} AS area_d_i_o_gt_i_o, {_mean("lam1")} AS lam, {_mean("d_lam")} AS d_lam, {_share("lam1 > 1", "lam1 IS NOT NULL")} AS area_lam_gt1,
  {_share("low > 1", "lam1 IS NOT NULL")} AS area_band_gt1, {_share("high < 1", "lam1 IS NOT NULL")} AS area_band_lt1, {_share("low <= 1 AND high >= 1", "lam1 IS NOT NULL")} AS area_band_contains1,
  1 - {_share("lam1 IS NOT NULL", "i_o1 IS NOT NULL")} AS area_lam_undefined, min(b_f) AS least_f, max(b_f) AS most_f, min(b_o) AS least_o, max(b_o) AS most_o, min(b_s) AS least_s, max(b_s) AS most_s
  FROM bd JOIN (SELECT DISTINCT cell, b_f, b_o, b_s FROM bb) USING (cell) JOIN g USING (cell))""", [],
  ["i_o", "i_m", "d_i_o", "d_i_m", "med_rel_d_i_o", "area_d_i_o_gt_i_o", "lam", "d_lam", "area_lam_gt1", "area_band_gt1", "area_band_lt1", "area_band_contains1", "area_lam_undefined"],
  ["least_f", "most_f", "least_o", "most_o", "least_s", "most_s"]))
def area_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, obs = ensembles.from_embeddings(spark, sf_dir)
    points = draws.points(members, obs)
    return area.rule_row(information.band(points), points.where("alt = 1").select("cell", "b_f", "b_o", "b_s"), grid_of(members).select("cell", "w"))


@query(select(_FD, "(SELECT cell, r.range AS range FROM (SELECT DISTINCT cell, CASE cell % 8 WHEN 0 THEN cell + 1 WHEN 7 THEN cell - 1 ELSE cell END AS source FROM m) JOIN (SELECT cell AS source, abs(max(CASE WHEN alt = 1.5 THEN lam END) - max(CASE WHEN alt = 0.5 THEN lam END)) AS range FROM pt GROUP BY cell) r USING (source))", ["cell"], ["range"]))
def band_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return area.band_ranges(draws.points(*ensembles.from_embeddings(spark, sf_dir)), 8)


_SWEEP = (2, 4, 8, 16)


def _sweep_sql() -> str:
    return E + f""", x AS (SELECT cell, min(f) f0, max(f) f1, min(o) o0, max(o) o1, min(s) s0, max(s) s1 FROM p GROUP BY cell),
j AS (SELECT p.*, x.* EXCLUDE (cell), b FROM p JOIN x USING (cell) CROSS JOIN (SELECT UNNEST({list(_SWEEP)}) AS b)),
co AS (SELECT cell, b, {sql_bin("o", "o0", "o1", "b")} AS cx, {sql_bin("f", "f0", "f1", "b")} AS cy FROM j), cm AS (SELECT cell, b, {sql_bin("s", "s0", "s1", "b")} AS cx, {sql_bin("f", "f0", "f1", "b")} AS cy FROM j),
sw AS (SELECT cell, b, a.mi AS i_o, c.mi AS i_m, {sql_lambda("a.mi")} AS lam_o, {sql_lambda("c.mi")} AS lam_m, {sql_lambda("a.mi")} / {sql_lambda("c.mi")} AS lam FROM {sql_information("co", "cell, b")} a JOIN {sql_information("cm", "cell, b")} c USING (cell, b))"""


@query(select(_sweep_sql(), "sw", ["cell"], ["i_o", "i_m", "lam_o", "lam_m", "lam"], ["b"]))
def fixed_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return information.fixed_sweep(*ensembles.from_embeddings(spark, sf_dir), _SWEEP)


def _knuth(series: str, most: int) -> str:
    """Relation kb(cell, axis, bins) from series(cell, axis, x)."""
    return f""", sr AS ({series}),
k1 AS (SELECT cell, axis, x, m, n, {sql_bin("x", "x0", "x1", "m")} AS k FROM sr JOIN (SELECT cell, axis, min(x) x0, max(x) x1, count(*) n FROM sr GROUP BY ALL) USING (cell, axis) CROSS JOIN (SELECT UNNEST(range(1, {most + 1})) AS m)),
k2 AS (SELECT cell, axis, m, n, k, count(*) AS c FROM k1 WHERE m <= n GROUP BY ALL),
k3 AS (SELECT cell, axis, m, n * ln(m) + lgamma(m / 2) - lgamma(n + m / 2) - m * lgamma(0.5) + sum(lgamma(c + 0.5)) + (m - count(*)) * lgamma(0.5) AS score FROM k2 GROUP BY cell, axis, m, n),
kb AS (SELECT cell, axis, arg_max(m, round(score, 9) - m * 1e-12) AS bins FROM k3 GROUP BY ALL)"""


_KNUTH = E + _knuth("SELECT cell, 'o' AS axis, o AS x FROM o UNION ALL SELECT cell, 's', s FROM (SELECT cell, t, avg(f) AS s FROM m GROUP BY ALL)", 200)


@query(select(_KNUTH, "kb", ["cell", "axis"], [], ["bins"]))
def knuth_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, obs = ensembles.from_embeddings(spark, sf_dir)
    rows = obs.select("cell", F.lit("o").alias("axis"), F.col("o").alias("x")).unionByName(pairs.ensemble_mean(members).select("cell", F.lit("s").alias("axis"), F.col("s").alias("x")))
    return information.knuth_counts(rows, "x", ["cell", "axis"])


_AXES = _ONCE + _knuth("SELECT cell, 'f' AS axis, f AS x FROM p UNION ALL SELECT cell, 'o', o FROM once UNION ALL SELECT cell, 's', loo FROM once", 200)
_KNUTH_POINTS = _points_sql("[0.5, 1.0, 1.5]", "f", "loo", *[f"SELECT cell, bins AS b_{a} FROM kb WHERE axis = '{x}'" for a, x in (("o", "o"), ("s", "s"), ("p", "f"))], more=_AXES, b_f="SELECT cell, bins AS b_f FROM kb WHERE axis = 'f'")


@query(select(_KNUTH_POINTS, "pt", *_POINT))
def point_lambda_knuth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draws.points(*ensembles.from_embeddings(spark, sf_dir), rule="knuth", s="loo", loo_size="T", tiled=False)


def _z(x: str, by: str) -> str:
    """The normal score of a column among the rows of its group: its share of the ranks, to be put through ``sql_quantile``."""
    return f"(rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0 - 0.5) / count(*) OVER (PARTITION BY {by})"


_SCORED = E.replace("p AS (SELECT ms.*, o.o FROM ms JOIN o USING (cell, t))", f"""zm AS (SELECT cell, member, t, {sql_quantile("qf")} AS f, {sql_quantile("ql")} AS loo FROM (SELECT cell, member, t, {_z("f", "cell")} AS qf, {_z("loo", "cell")} AS ql FROM ms)),
zo AS (SELECT cell, t, {sql_quantile("q")} AS o FROM (SELECT cell, t, {_z("o", "cell")} AS q FROM o)), p AS (SELECT zm.*, 0.0 AS s, zo.o FROM zm JOIN zo USING (cell, t))""")


@query(select(_LOO.replace(E, _SCORED), "pt", *_POINT))
def point_lambda_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draws.points(*ensembles.from_embeddings(spark, sf_dir), s="loo", o_vs="loo", loo_size="T", tiled=False, scores=True)


@query(select(_FD + f""", h AS (SELECT a.cell, a.alt, a.mi AS i_gf, c.mi AS i_sf, a.h_y AS h_f, a.h_x AS h_g FROM {sql_information("co", "cell, alt")} a JOIN {sql_information("cm", "cell, alt")} c USING (cell, alt))""",
  "(SELECT *, i_gf / h_g AS gamma_o, i_sf / h_f AS gamma_m, (i_gf / h_g) / (i_sf / h_f) AS gamma FROM h)", ["cell", "alt::DOUBLE AS alt"], ["i_gf", "i_sf", "h_f", "h_g", "gamma_o", "gamma_m", "gamma"]))
def entropy_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return information.entropy_ratios(*ensembles.from_embeddings(spark, sf_dir))


_SCORES = """WITH v AS (SELECT event_type AS cell, event_id, value::DOUBLE AS f FROM events),
r AS (SELECT *, (rank() OVER (PARTITION BY cell ORDER BY f) + (count(*) OVER (PARTITION BY cell, f) - 1) / 2.0 - 0.5) / count(*) OVER (PARTITION BY cell) AS q FROM v)"""


@query(select(_SCORES, f"(SELECT cell, event_id, {sql_quantile('q')} AS z FROM r)", ["cell", "event_id"], ["z"]))
def normal_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ensembles.table(spark, sf_dir, "events").select(F.col("event_type").alias("cell"), "event_id", F.col("value").cast("double").alias("f"))
    return information.spread_scores(rows, "f", ["cell"], "z").select("cell", "event_id", "z")  # a kind of event may hold most of them


@query(select(E + f""", pr AS (SELECT a.cell, b.member AS later, a.f AS y, b.f AS x FROM m a JOIN m b ON a.cell = b.cell AND a.t = b.t AND a.member < b.member),
c AS (SELECT cell, later, {sql_bin("x", "x0", "x1", "4")} AS cx, {sql_bin("y", "y0", "y1", "4")} AS cy FROM pr JOIN (SELECT cell, later, min(x) x0, max(x) x1, min(y) y0, max(y) y1 FROM pr GROUP BY ALL) USING (cell, later))""",
  f"(SELECT cell, sum(mi) AS tc FROM {sql_information('c', 'cell, later')} GROUP BY cell)", ["cell"], ["tc"]))
def total_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return information.total_correlation(ensembles.from_embeddings(spark, sf_dir)[0], 4)


@query(select(f"""WITH v AS (SELECT event_type AS cell, value::DOUBLE AS f FROM events), g AS (SELECT cell, greatest(abs(quantile_cont(f, 0.001)), abs(quantile_cont(f, 0.999))) AS edge FROM v GROUP BY cell),
c AS (SELECT cell, edge, {sql_bin("f", "-edge", "edge", "40")} AS bin, count(*) AS c FROM v JOIN g USING (cell) WHERE abs(f) <= edge GROUP BY ALL)""",
  "(SELECT cell, bin, c / (sum(c) OVER (PARTITION BY cell) * 2 * edge / 40) AS density FROM c)", ["cell"], ["density"], ["bin"]))
def pooled_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ensembles.table(spark, sf_dir, "events").select(F.col("event_type").alias("cell"), F.col("value").cast("double").alias("f"))
    return information.density(rows, "f", 40, ["cell"], 0.001).drop("centre")  # centres lie on rounding ties


@query(select(E + _RHO + """, a AS (SELECT cell, rho_o / rho_m AS a, sd_ratio AS b FROM ro JOIN rm USING (cell) JOIN sd USING (cell)),
k AS (SELECT rank() OVER (ORDER BY a) AS ra, rank() OVER (ORDER BY b) AS rb, ((a > 1) = (b > 1))::INT AS same FROM a)""", "(SELECT corr(ra, rb) AS rho, avg(same) AS same_class FROM k)", [], ["rho", "same_class"]))
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rho.measures(*ensembles.from_embeddings(spark, sf_dir)).select("cell", (F.col("rho_o") / F.col("rho_m")).alias("a"), F.col("sd_ratio").alias("b"))
    return area.spearman(found, "a", "b")


@query(select(E, """(SELECT a.cell, a.t, count(*) FILTER (abs(a.s - b.s) < a.eps) - 1 AS nx, count(*) FILTER (abs(a.o - b.o) < a.eps) - 1 AS ny FROM
  (SELECT a.cell, a.t, any_value(a.s) AS s, any_value(a.o) AS o, list_sort(list(greatest(abs(a.s - b.s), abs(a.o - b.o))))[5] AS eps FROM z a JOIN z b USING (cell) GROUP BY a.cell, a.t) a JOIN z b USING (cell) GROUP BY a.cell, a.t)""", ["cell"], [], ["nx", "ny"]).replace("\nSELECT", ", z AS (SELECT cell, t, s, o FROM (SELECT cell, t, avg(f) AS s FROM m GROUP BY ALL) JOIN o USING (cell, t))\nSELECT", 1))
def ksg_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, obs = ensembles.from_embeddings(spark, sf_dir)
    rows = pairs.ensemble_mean(members).join(obs, ["cell", "t"]).select("cell", F.col("s").alias("x"), F.col("o").alias("y"))
    return neighbours.neighbour_counts(rows, ["cell"])


@query()
def ksg_lambda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.ksg_cells(*ensembles.from_embeddings(spark, sf_dir))
