"""Queries: cases built from the line items, read as monthly files of several models, and the checks of result folders.

A return flag and line status is a model, suppliers by remainder its members, parts the cells; a model's files hold half a year each. Prices are scaled by a
prime, so that no mean of them ends in the half of a sixth digit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwise.operators import area, draws, exchange, information, resample, rho
from cellwise.plans.inference import _AS_OBS, _MODELS, _SIG, BINS, BLOCK, MEMBERS, REPS, _by_model, _times
from cellwise.plans.registry import GRID, E, query, select
from cellwise.plans.statistics import _FD, _RHO, _mean, _share, grid_of
from cellwise.plans.summaries import _WEIGHTS
from cellwise.sources import cases, catalog, ensembles

_LEADS = [(1, 1), (2, 4), (13, 24)]
_MONTHS = """WITH v AS (SELECT l_returnflag || l_linestatus AS model, (l_suppkey % 10)::BIGINT AS name, (l_partkey % 4)::BIGINT AS cell,
  (year(l_shipdate) * 12 + month(l_shipdate) - 1)::BIGINT AS t, avg(l_extendedprice::DOUBLE) / 997 AS f FROM lineitem GROUP BY ALL)"""
_WINDOWS = _MONTHS + """, w AS (SELECT model, t AS init, a AS lead_from, b AS lead_to, t + a - 1 AS w_lo, t + b - 1 AS w_hi FROM (SELECT DISTINCT model, t FROM v WHERE t % 12 = 10) CROSS JOIN (SELECT * FROM (VALUES (1, 1), (2, 4), (13, 24)) l(a, b)))"""


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, name, cell, t, f)."""
    month = (F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1).cast("int")
    keys = [F.concat("l_returnflag", "l_linestatus").alias("model"), (F.col("l_suppkey") % 10).cast("int").alias("name"), (F.col("l_partkey") % 4).cast("int").alias("cell"), month.alias("t")]
    return ensembles.table(spark, sf_dir, "lineitem").groupBy(*keys).agg((F.avg(F.col("l_extendedprice").cast("double")) / 997).alias("f"))


def _as_files(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files(model, name, title, lo, hi) and values(title, cell, t, f)."""
    titled = rows.withColumn("title", F.concat_ws("-", "model", "name", F.floor(F.col("t") / 6)))
    return titled.groupBy("model", "name", "title").agg(F.min("t").alias("lo"), F.max("t").alias("hi")), titled.select("title", "cell", "t", "f")


def _windows(rows: DataFrame) -> DataFrame:
    leads = F.explode(F.array(*[F.struct(F.lit(a).alias("lead_from"), F.lit(b).alias("lead_to")) for a, b in _LEADS]))
    starts = rows.where("t % 12 = 10").select("model", F.col("t").alias("init")).distinct().select("model", "init", leads.alias("l")).select("model", "init", "l.*")
    return starts.withColumns({"w_lo": F.col("init") + F.col("lead_from") - 1, "w_hi": F.col("init") + F.col("lead_to") - 1})


@query(select(_WINDOWS, "(SELECT model, name, init, lead_from, lead_to, cell, avg(f) AS f FROM v JOIN w USING (model) WHERE t BETWEEN w_lo AND w_hi GROUP BY ALL HAVING count(*) = max(w_hi - w_lo + 1))", ["model", "name", "init", "cell"], ["f"], ["lead_from", "lead_to"]))
def window_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _monthly(spark, sf_dir)
    files, values = _as_files(rows)
    return cases.window_means(files, values, _windows(rows), ["model", "name"])


@query(select(_WINDOWS, "(SELECT DISTINCT model, UNNEST(range(w_lo, w_hi + 1)) AS t FROM w)", ["model", "t"]))
def wanted_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.wanted_months(_windows(_monthly(spark, sf_dir)), ["model"])


@query(select(_MONTHS, "(SELECT model, name, min(t) AS lo, max(t) AS hi FROM v GROUP BY model, name HAVING min(t) <= (SELECT min(k.t) FROM v k WHERE k.model = v.model AND k.t % 12 = 10) AND max(t) >= (SELECT max(k.t) FROM v k WHERE k.model = v.model AND k.t % 12 = 10))", ["model", "name"], [], ["lo", "hi"]))
def covering_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _monthly(spark, sf_dir)
    spans = _as_files(rows)[0].groupBy("model", "name").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    starts = rows.where("t % 12 = 10").groupBy("model").agg(F.min("t").alias("w_lo"), F.max("t").alias("w_hi"))
    return cases.covering(spans, starts)


# start years of the models: NO begins in November, and is alone in having observations of every year
_POOL = """WITH y AS (SELECT l_returnflag || l_linestatus AS model, (l_suppkey % 10)::BIGINT AS name, (l_partkey % 4)::BIGINT AS cell, year(l_shipdate)::BIGINT AS year, avg(l_extendedprice::DOUBLE) / 997 AS f FROM lineitem GROUP BY ALL),
ob AS (SELECT model, year, cell, avg(f) / 2 + cell AS o FROM y WHERE year % 5 <> 0 OR model = 'NO' GROUP BY model, year, cell),
ks AS (SELECT DISTINCT model, year FROM y WHERE (model, year) IN (SELECT (model, year) FROM ob)),
cy AS (SELECT year, row_number() OVER (ORDER BY year) - 1 AS t FROM ks GROUP BY year HAVING count(*) = (SELECT count(DISTINCT model) FROM ks)),
nb AS (SELECT model, name, row_number() OVER (ORDER BY model, name) AS member FROM (SELECT DISTINCT model, name FROM y)),
fp AS (SELECT cell, y.model, member, t, f FROM y JOIN cy USING (year) JOIN nb USING (model, name)), op AS (SELECT cell, t, o FROM ob JOIN cy USING (year) WHERE model = 'NO')"""


def _less_line(x: str, by: str) -> str:
    w = f"OVER (PARTITION BY {by})"
    return f"{x} - avg({x}) {w} - (t - avg(t) {w}) * coalesce(covar_pop({x}, t) {w} / nullif(var_pop(t) {w}, 0), 0)"


def _pool(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    keys = [F.concat("l_returnflag", "l_linestatus").alias("model"), (F.col("l_suppkey") % 10).cast("int").alias("name"), (F.col("l_partkey") % 4).cast("int").alias("cell"), F.year("l_shipdate").alias("year")]
    rows = ensembles.table(spark, sf_dir, "lineitem").groupBy(*keys).agg((F.avg(F.col("l_extendedprice").cast("double")) / 997).alias("f"))
    obs = rows.where("year % 5 <> 0 OR model = 'NO'").groupBy("model", "year", "cell").agg((F.avg("f") / 2 + F.col("cell")).alias("o"))
    inits = rows.select("model", F.when(F.col("model") == "NO", 11).otherwise(1).alias("init_month")).distinct()
    return rows, obs, inits


@query(select(_POOL, f"(SELECT cell, model, member, t, {_less_line('f', 'cell, member')} AS f FROM fp)", ["cell", "model"], ["f"], ["member", "t"]))
def pooled_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.pooled(*_pool(spark, sf_dir))[0]


@query(select(_POOL, f"(SELECT cell, t, {_less_line('o', 'cell')} AS o FROM op)", ["cell"], ["o"], ["t"]))
def pooled_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.pooled(*_pool(spark, sf_dir))[1]


@query(select(_POOL, "(SELECT model, count(*) - count(*) FILTER (year IN (SELECT year FROM cy)) AS dropped FROM ks GROUP BY model)", ["model"], [], ["dropped"]))
def pooled_dropped_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, obs, _ = _pool(spark, sf_dir)
    return cases.common_years(rows, obs)[1]


@query(select(_MONTHS + f""", nb AS (SELECT model, name, row_number() OVER (ORDER BY model, name) AS member FROM (SELECT DISTINCT model, name FROM v)),
an AS (SELECT cell, model, member, t, f - avg(f) OVER (PARTITION BY cell, model, t % 12) AS f FROM v JOIN nb USING (model, name))""", f"(SELECT cell, model, member, t, {_less_line('f', 'cell, member')} AS f FROM an)", ["cell", "model", "t"], ["f"], ["member"]))  # fmt: skip
def decade_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _monthly(spark, sf_dir)
    obs = rows.groupBy("cell", "t").agg(F.avg("f").alias("o"))
    f = cases.decade(rows, obs)[0]
    return f.withColumn("t", F.col("t").cast("long"))


_BOTH = "(rho_o > 0 AND lam_m_avg IS NOT NULL AND lam_m_pool IS NOT NULL)"


def _above(x: str) -> str:
    r, v = f"(lam_o / nullif(lam_m_{x}, 0))", f"(rho_o > 0 AND lam_m_{x} > 0 AND lam_o IS NOT NULL)"
    return f"{_share(f'{r} > 1', v)} AS rpc_{x}_gt1, {_mean(f'(CASE WHEN {v} AND {r} > 1 THEN {r} END)')} AS rpc_{x}_mean, quantile_cont(CASE WHEN {v} AND {r} > 1 THEN {r} END, 0.5) AS rpc_{x}_median"


_SUMMED = (
    f"{_share('lam_o IS NULL', 'rho_o > 0')} AS area_lam_o_undefined, {_share('lam_m_pool IS NULL', 'rho_o > 0')} AS area_lam_m_pool_undefined, {_mean(f'(CASE WHEN {_BOTH} THEN lam_m_avg END)')} AS lam_m_avg, {_mean(f'(CASE WHEN {_BOTH} THEN lam_m_pool END)')} AS lam_m_pool, "
    f"{_mean(f'(CASE WHEN {_BOTH} THEN lam_m_avg - lam_m_pool END)')} AS avg_less_pool, {_share('lam_m_avg > lam_m_pool', _BOTH)} AS share_avg_gt_pool, {_above('avg')}, {_above('pool')}"
)
_SUMMED_COLUMNS = ["area_lam_o_undefined", "area_lam_m_pool_undefined", "lam_m_avg", "lam_m_pool", "avg_less_pool", "share_avg_gt_pool", *[f"rpc_{x}_{y}" for x in ("avg", "pool") for y in ("gt1", "mean", "median")]]


@query(select(f"WITH a AS ({_FD} SELECT cell, lam_o, lam_m AS lam_m_pool FROM pt WHERE alt = 1), k AS ({_AS_OBS} SELECT cell // 100 AS cell, lam_o AS lam FROM pt), r AS ({E}{_RHO} SELECT cell, rho_o FROM ro), {_WEIGHTS}, "
  "c AS (SELECT * FROM a JOIN (SELECT cell, avg(lam) AS lam_m_avg FROM k GROUP BY cell) USING (cell) JOIN r USING (cell) JOIN g USING (cell))",
  f"(SELECT {_SUMMED} FROM c)", [], _SUMMED_COLUMNS))
def definition_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of lambda from all members' pairs, and as the mean over members as observations."""
    members, obs = ensembles.from_embeddings(spark, sf_dir)
    points = draws.points(members, obs, alts=(1.0,)).select("cell", "lam_o", F.col("lam_m").alias("lam_m_pool"))
    average = draws.points_as_obs(members, alts=(1.0,)).groupBy("cell").agg(F.avg("lam_o").alias("lam_m_avg"))
    maps = points.join(average, "cell").join(rho.measures(members, obs).select("cell", "rho_o"), "cell")
    return area.definition_summary(maps, grid_of(members).select("cell", "w"))


@query(select(f"{_MODELS}, {GRID}, c AS (SELECT bm.*, w FROM bm JOIN g USING (cell))", f"(SELECT model, {_SUMMED} FROM c GROUP BY model)", ["model"], _SUMMED_COLUMNS))
def definition_summary_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inside each model, of lambda from all its members' pairs and as the mean of their own, both less their null."""
    cells = grid_of(ensembles.from_embeddings(spark, sf_dir)[0])
    return area.definition_summary(_by_model(spark, sf_dir), cells.select("cell", "w"), ["model"])


_Z = 1.959963984540054


@query(select(_SIG, f"""(SELECT stat, n, k / n AS rejected, greatest(0, (k / n + {_Z} * {_Z} / (2 * n) - {_Z} * sqrt(k / n * (1 - k / n) / n + {_Z} * {_Z} / (4 * n * n))) / (1 + {_Z} * {_Z} / n)) AS low,
  least(1, (k / n + {_Z} * {_Z} / (2 * n) + {_Z} * sqrt(k / n * (1 - k / n) / n + {_Z} * {_Z} / (4 * n * n))) / (1 + {_Z} * {_Z} / n)) AS high, mean AS corrected
  FROM (SELECT stat, count(*)::DOUBLE AS n, count(*) FILTER (p <= 0.05)::DOUBLE AS k, avg(corrected) AS mean FROM sg WHERE p IS NOT NULL GROUP BY stat))""", ["stat"], ["rejected", "low", "high", "corrected"], ["n"]))  # fmt: skip
def rejection_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the exchangeability test rejects, each cell a draw, with Wilson's interval."""
    members = ensembles.from_embeddings(spark, sf_dir)[0]
    perms = exchange.Rotations(REPS, _times(members), MEMBERS, BLOCK)
    return exchange.rejection_shares(exchange.significance(exchange.test_statistics(members, perms, BINS)))


@query()
def ksg_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, obs = ensembles.from_embeddings(spark, sf_dir)
    return resample.ksg_bootstrap(members, obs, draws.Modular(_times(members), MEMBERS, 20))


_SET = """WITH n AS (SELECT o_orderkey AS id, o_orderstatus AS s, o_totalprice::DOUBLE / 1000 AS mb, o_custkey % 9 AS k FROM orders),
en AS (SELECT CASE WHEN id % 13 = 0 THEN 'Other/' ELSE 'Set/' END || 'p' || k || '/' || id AS dest, 'src/' || id AS source, 'p' || CASE WHEN id % 17 = 0 THEN 0 ELSE k END AS section, CASE WHEN id % 6 <> 0 THEN sha256(s) END AS want FROM n WHERE id % 7 <> 0),
ds AS (SELECT CASE WHEN id % 13 = 0 THEN 'Other/' ELSE 'Set/' END || 'p' || k || '/' || id AS dest, mb, sha256(CASE WHEN id % 11 = 0 THEN 'x' ELSE s END) AS have FROM n WHERE id % 3 <> 0), sr AS (SELECT 'src/' || id AS source, sha256(CASE WHEN id % 8 = 0 THEN 'y' ELSE s END) AS origin FROM n WHERE id % 5 <> 0)"""
_JOINED = "FROM en LEFT JOIN ds USING (dest) LEFT JOIN sr USING (source)"


def _set(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """entries(dest, source, section, sha256), files of the set (dest, size, sha256) and sources (source, sha256)."""
    n = ensembles.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("s"), (F.col("o_totalprice").cast("double") * 1000).alias("size"), (F.col("o_custkey") % 9).alias("k"))
    n = n.withColumns({"dest": F.concat(F.when(F.col("id") % 13 == 0, "Other/").otherwise("Set/"), F.lit("p"), "k", F.lit("/"), "id"), "source": F.concat(F.lit("src/"), "id")})
    or_ = lambda every, text: F.sha2(F.when(F.col("id") % every == 0, text).otherwise(F.col("s")), 256)
    section = F.concat(F.lit("p"), F.when(F.col("id") % 17 == 0, 0).otherwise(F.col("k")))
    entries = n.where("id % 7 <> 0").select("dest", "source", section.alias("section"), F.when(F.col("id") % 6 != 0, F.sha2("s", 256)).alias("sha256"))
    return entries, n.where("id % 3 <> 0").select("dest", "size", or_(11, "x").alias("sha256")), n.where("id % 5 <> 0").select("source", or_(8, "y").alias("sha256"))


@query(_SET + f"""
SELECT dest, 'outside' AS problem FROM en WHERE NOT starts_with(dest, 'Set/') UNION ALL SELECT dest, 'section' FROM en WHERE split_part(dest, '/', 2) <> section
UNION ALL SELECT dest, 'missing' {_JOINED} WHERE have IS NULL UNION ALL SELECT dest, 'source missing' {_JOINED} WHERE have IS NOT NULL AND origin IS NULL
UNION ALL SELECT dest, 'differs from source' {_JOINED} WHERE have <> origin UNION ALL SELECT dest, 'unrecorded' {_JOINED} WHERE have IS NOT NULL AND want IS NULL
UNION ALL SELECT dest, 'changed' {_JOINED} WHERE have <> want UNION ALL SELECT dest, 'too large' {_JOINED} WHERE mb > 300
UNION ALL SELECT dest, 'orphan' FROM ds WHERE starts_with(dest, 'Set/') AND dest NOT IN (SELECT dest FROM en)""")
def figure_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.set_problems(*_set(spark, sf_dir), "Set", most_mb=300.0)


@query(_SET + "\nSELECT dest, source, section, CASE WHEN contains(dest, '/p3/') AND have IS NOT NULL THEN have ELSE want END AS sha256 FROM en LEFT JOIN ds USING (dest)")
def figure_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, files, _ = _set(spark, sf_dir)
    return catalog.refreshed(entries, files, "/p3/")
