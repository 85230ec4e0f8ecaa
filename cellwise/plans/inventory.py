"""Queries: windows, complete blocks, spans, manifests and file states, on the given tables read as inventories.

Orders stand for files: a customer's nation is the model, its number in the nation's region the member, an order's months the span.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwise.functions import scalar
from cellwise.plans.registry import L, query, select
from cellwise.sources import catalog, ensembles

_INIT = ", ini AS (SELECT DISTINCT t AS init FROM r WHERE t % 12 = 10)"


@query(select(L + _INIT, """(SELECT init, a AS lead_from, b AS lead_to, avg(o) AS o FROM ini CROSS JOIN (SELECT * FROM (VALUES (1, 1), (2, 4), (13, 24)) v(a, b)) JOIN r ON r.t BETWEEN init + a - 1 AND init + b - 1 GROUP BY init, a, b HAVING count(*) = b - a + 1)""", ["init"], ["o"], ["lead_from", "lead_to"]))
def lead_window_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = ensembles.from_orders(spark, sf_dir)
    starts = series.where("t % 12 = 10").select(F.col("t").alias("init"))
    return catalog.lead_windows(starts, series, scalar.parse_leads("1,2-4,13-24"))


@query(select(L, "(SELECT t FROM l GROUP BY t HAVING count(DISTINCT member) = (SELECT count(DISTINCT member) FROM l))", ["t"]))
def common_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all cells together, where ``common_months_whole`` has each cell's own."""
    return catalog.common_keys(ensembles.from_lineitem(spark, sf_dir), "t", "member")


@query(select(L, "(SELECT cell, t FROM l GROUP BY cell, t HAVING count(DISTINCT member) = (SELECT count(DISTINCT member) FROM l k WHERE k.cell = l.cell))", ["cell", "t"]))
def common_months_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every cell its own."""
    return catalog.common_keys(ensembles.from_lineitem(spark, sf_dir), "t", "member", ["cell"])


_SUPPLIED = "SELECT DISTINCT {} AS member, (year(l_shipdate) * 12 + month(l_shipdate) - 1)::BIGINT AS start FROM lineitem"
_COVER = f"WITH q AS ({_SUPPLIED.format('l_suppkey')})"
_COVER_ALL = f"WITH c AS ({_SUPPLIED.format('l_suppkey % 10')}), q AS (SELECT start, member FROM c WHERE (start * 7 + member * 5) % 41 <> 0)"


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The months of every supplier."""
    month = (F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1).cast("int").alias("start")
    return ensembles.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("member"), month).distinct()


def _coverage_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all suppliers, a member per group of them as in ``ensembles.from_lineitem``; a rule on month and member makes the holes, at any size of the table."""
    return _coverage(spark, sf_dir).select("start", (F.col("member") % 10).alias("member")).distinct().where("(start * 7 + member * 5) % 41 <> 0")


@query()
def largest_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts, members = catalog.largest_block(_coverage_all(spark, sf_dir))
    side = lambda df, name: df.select(F.lit(name).alias("side"), F.col(name).cast("long").alias("id"))
    return side(starts, "start").unionByName(side(members, "member"))


@query(select(_COVER, "(SELECT member, count(*) AS dropped FROM q WHERE start NOT IN (SELECT start FROM q GROUP BY start HAVING count(DISTINCT member) = (SELECT count(DISTINCT member) FROM q)) GROUP BY member)", ["member"], [], ["dropped"]))
def dropped_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.dropped_keys(_coverage(spark, sf_dir), "start", "member")


@query(select(_COVER_ALL, "(SELECT member, count(*) AS dropped FROM q WHERE start NOT IN (SELECT start FROM q GROUP BY start HAVING count(DISTINCT member) = (SELECT count(DISTINCT member) FROM q)) GROUP BY member)", ["member"], [], ["dropped"]))
def dropped_starts_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By groups of suppliers with holes, where ``dropped_starts`` has every supplier's own months."""
    return catalog.dropped_keys(_coverage_all(spark, sf_dir), "start", "member")


_FILES = """WITH f AS (SELECT o_orderkey AS id, n_name AS model, o_orderpriority AS var, (year(o_orderdate) * 12 + month(o_orderdate) - 1)::BIGINT AS lo,
  (year(o_orderdate) * 12 + month(o_orderdate) - 1 + o_orderkey % 30)::BIGINT AS hi, o_custkey AS member, o_totalprice::DOUBLE AS size FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = (ensembles.table(spark, sf_dir, n) for n in ("orders", "customer", "nation"))
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(
        F.col("o_orderkey").alias("id"), F.col("n_name").alias("model"), F.col("o_orderpriority").alias("var"), month.cast("long").alias("lo"),
        (month + F.col("o_orderkey") % 30).cast("long").alias("hi"), F.col("o_custkey").alias("member"), F.col("o_totalprice").cast("double").alias("size"),
    )


@query(select(_FILES + ", w AS (SELECT n_name AS model, 23940 + n_nationkey AS w_lo, 23940 + n_nationkey + 13 AS w_hi FROM nation)", "(SELECT id, f.model, lo, hi FROM f JOIN w ON f.model = w.model AND lo <= w_hi AND hi >= w_lo)", ["id", "model"], [], ["lo", "hi"]))
def span_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = ensembles.table(spark, sf_dir, "nation")
    windows = nation.select(F.col("n_name").alias("model"), (F.col("n_nationkey") + 23940).cast("long").alias("w_lo"), (F.col("n_nationkey") + 23953).cast("long").alias("w_hi"))
    return catalog.overlapping(_files(spark, sf_dir), windows, ["model"]).select("id", "model", "lo", "hi")


@query(select(_FILES, "(SELECT model, var, count(*) AS files, sum(size) AS bytes, count(DISTINCT member) AS members, count(DISTINCT lo) AS starts, min(lo)::VARCHAR AS first_month FROM f GROUP BY model, var)", ["model", "var", "first_month"], ["bytes"], ["files", "members", "starts"]))
def manifest_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _files(spark, sf_dir).withColumns({"start": F.col("lo"), "first_month": F.col("lo").cast("string")})
    return catalog.plan(rows)


@query(select(_FILES, "(SELECT model, member, min(lo) AS lo, max(hi) AS hi, count(*) AS chunks FROM f GROUP BY model, member)", ["model", "member"], [], ["lo", "hi", "chunks"]))
def member_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _files(spark, sf_dir).withColumns({"start": F.lit(1), "title": F.col("id").cast("string"), "var": F.lit("v")})
    return catalog.index_of(rows).select("model", "member", "lo", "hi", F.size("chunks").alias("chunks"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'new' ELSE o_orderstatus END AS state FROM orders""")
def manifest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = ensembles.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"))
    return catalog.upsert(old, old.where("id % 5 = 0").withColumn("state", F.lit("new")), "id")


_STATES = """WITH a AS (SELECT o_orderkey AS dest, sha256(o_orderstatus) AS want FROM orders WHERE o_orderkey % 7 <> 0), b AS (SELECT o_orderkey AS dest, sha256(CASE WHEN o_orderkey % 11 = 0 THEN 'x' ELSE o_orderstatus END) AS have FROM orders WHERE o_orderkey % 3 <> 0)"""


@query(_STATES + "\nSELECT dest, CASE WHEN have IS NULL THEN 'missing' WHEN want IS NULL THEN 'orphan' WHEN want = have THEN 'ok' ELSE 'changed' END AS state FROM a FULL JOIN b USING (dest)")
def manifest_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = ensembles.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("dest"), F.col("o_orderstatus").alias("text"))
    entries = orders.where("dest % 7 <> 0").select("dest", F.sha2("text", 256).alias("sha256"))
    changed = F.when(F.col("dest") % 11 == 0, "x").otherwise(F.col("text"))
    return catalog.verified(entries, orders.where("dest % 3 <> 0").select("dest", F.sha2(changed, 256).alias("sha256")))


@query(_FILES + """, s AS (SELECT model, var AS start, min(lo) AS month FROM f GROUP BY model, var)
SELECT model, coalesce(CASE WHEN count(DISTINCT month % 12) = 1 THEN min(month % 12 + 1) END::VARCHAR, 'varies') AS init_month FROM s GROUP BY model""")
def init_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = scalar.month_label(F.col("lo"))
    firsts = catalog.first_months(_files(spark, sf_dir).select("model", F.col("var").alias("start"), label.alias("first_month")))
    return catalog.start_constants(firsts).select("model", F.coalesce(F.col("init_month").cast("string"), F.lit("varies")).alias("init_month"))


@query(_FILES + """, s AS (SELECT model, lo // 12 - length(model) % 3 AS start, min(lo) AS month FROM f GROUP BY ALL)
SELECT model, (CASE WHEN count(DISTINCT month // 12 - start) = 1 THEN min(month // 12 - start) END)::BIGINT AS offset_years FROM s GROUP BY model""")
def init_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The year in which lead 1 begins less the start's, where a model's starts agree; here starts are named by a year up to two before."""
    start = F.concat(F.lit("s"), F.floor(F.col("lo") / 12) - F.length("model") % 3)
    firsts = catalog.first_months(_files(spark, sf_dir).select("model", start.alias("start"), scalar.month_label(F.col("lo")).alias("first_month")))
    return catalog.start_constants(firsts).select("model", F.col("offset_years").cast("long").alias("offset_years"))


@query(_FILES + """, s AS (SELECT model, var, id % 5 AS start, min(lo) AS month FROM f GROUP BY ALL)
SELECT model, var, init_months, on_disk FROM (SELECT model, var, count(*) FILTER (id % 3 = 0)::BIGINT AS on_disk FROM f GROUP BY ALL)
  JOIN (SELECT model, var, array_to_string(list_sort(list(DISTINCT month % 12 + 1)), ',') AS init_months FROM s GROUP BY ALL) USING (model, var)""")
def planned_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _files(spark, sf_dir).withColumns({"title": F.col("id").cast("string"), "start": F.col("id") % 5, "first_month": scalar.month_label(F.col("lo"))})
    return catalog.planned_starts(rows, rows.where("id % 3 = 0").select("title"))


@query("""SELECT o_orderkey AS id, (year(o_orderdate) * 12 + month(o_orderdate) - 1)::BIGINT AS month, strftime(o_orderdate, '%Y-%m') AS label, month(o_orderdate)::BIGINT AS moy FROM orders""")
def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ensembles.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), scalar.month_index(F.year("o_orderdate"), F.month("o_orderdate")).alias("month"))
    return rows.withColumns({"label": scalar.month_label(F.col("month")), "moy": scalar.month_of_year(F.col("month"))})


@query("""WITH s AS (SELECT l_returnflag AS k, count(*) FILTER (l_discount > 0.05)::DOUBLE AS h, count(*)::DOUBLE AS n FROM lineitem GROUP BY l_returnflag), w AS (SELECT k, h / n AS p, n, 1.959963984540054 AS z FROM s)
SELECT k, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) + 0.0 AS low, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) + 0.0 AS high FROM w""")
def wilson_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ensembles.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("k")).agg(F.count_if(F.col("l_discount") > 0.05).cast("double").alias("h"), F.count("*").cast("double").alias("n"))
    return rows.select("k", scalar.wilson(F.col("h"), F.col("n")).alias("w")).select("k", "w.low", "w.high")


@query("""WITH d AS (SELECT l_returnflag || l_linestatus AS cell, (l_suppkey % 10)::BIGINT AS member, (year(l_shipdate) * 12 + month(l_shipdate) - 1)::BIGINT AS t FROM lineitem GROUP BY ALL)
SELECT cell, member, t, 0::BIGINT AS count FROM (SELECT cell, member, t FROM (SELECT DISTINCT cell FROM d) CROSS JOIN (SELECT DISTINCT member FROM d) CROSS JOIN (SELECT DISTINCT t FROM d)) WHERE (cell, member, t) NOT IN (SELECT (cell, member, t) FROM d)""")
def uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = ensembles.from_lineitem(spark, sf_dir)
    axes = [done.select(c).distinct() for c in ("cell", "member", "t")]
    expected = axes[0].crossJoin(axes[1]).crossJoin(axes[2])  # the grid itself: as large as the complete cube
    return catalog.uncovered(expected, done, ["cell", "member", "t"])
