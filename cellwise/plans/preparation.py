"""Queries: detrending, anomalies, smoothing and regridding of the ensembles in the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwise.operators import area, prepare
from cellwise.plans.registry import GRID, E, L, query, select
from cellwise.plans.statistics import _RAGGED, _ragged
from cellwise.sources import ensembles

LATS, LONS = [-90 + (i + 0.5) * 22.5 for i in range(8)], [i * 45.0 for i in range(8)]


@query(select(E, "(SELECT cell, member, t, f - (regr_intercept(f, t) OVER w + regr_slope(f, t) OVER w * t) AS f FROM m WINDOW w AS (PARTITION BY cell, member))", ["cell", "member", "t"], ["f"]))
def detrend_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.detrend(ensembles.from_embeddings(spark, sf_dir)[0])


@query(select(_RAGGED, "(SELECT cell, member, t, CASE WHEN count(f) OVER w >= 3 THEN f - (regr_intercept(f, t) OVER w + regr_slope(f, t) OVER w * t) END AS f FROM q WINDOW w AS (PARTITION BY cell, member))", ["cell", "member", "t"], ["f"]))
def detrend_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.detrend(_ragged(spark, sf_dir), least=3)


@query(select(L, """(SELECT cell, member, t, f - avg(f) OVER w - CASE WHEN count(*) OVER w > 1 THEN regr_slope(f, k) OVER w ELSE 0 END * (k - avg(k) OVER w) AS f FROM (SELECT *, t % 12 // 3 AS season, row_number() OVER (PARTITION BY cell, member, t % 12 // 3 ORDER BY t) AS k FROM l)
  WINDOW w AS (PARTITION BY cell, member, season))""", ["cell", "member", "t"], ["f"]))
def detrend_by_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By quarters of the year, where ``detrend_by_season_whole`` goes by months."""
    rows = ensembles.from_lineitem(spark, sf_dir).withColumn("season", F.floor(F.col("t") % 12 / 3))
    return prepare.detrend_by_season(rows, "season").drop("season")


@query(select(L, """(SELECT cell, member, t, f - avg(f) OVER w - CASE WHEN count(*) OVER w > 1 THEN regr_slope(f, k) OVER w ELSE 0 END * (k - avg(k) OVER w) AS f FROM (SELECT *, t % 12 AS season, row_number() OVER (PARTITION BY cell, member, t % 12 ORDER BY t) AS k FROM l)
  WINDOW w AS (PARTITION BY cell, member, season))""", ["cell", "member", "t"], ["f"]))
def detrend_by_season_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By months."""
    rows = ensembles.from_lineitem(spark, sf_dir).withColumn("season", F.col("t") % 12)
    return prepare.detrend_by_season(rows, "season").drop("season")


@query(select(L, "(SELECT cell, member, t, f - avg(f) OVER (PARTITION BY cell, t % 12) AS f FROM l)", ["cell", "member", "t"], ["f"]))
def month_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ensembles.from_lineitem(spark, sf_dir).withColumn("season", F.col("t") % 12)
    return prepare.without_season(rows, "season").drop("season")


@query(select(E + ", " + GRID, "(SELECT cell, member, t, f - sum(w * f) OVER (PARTITION BY member, t) / sum(w) OVER (PARTITION BY member, t) AS f FROM m JOIN g USING (cell))", ["cell", "member", "t"], ["f"]))
def global_mean_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ensembles.with_grid(ensembles.from_embeddings(spark, sf_dir)[0])
    return prepare.without_global_mean(rows).select("cell", "member", "t", "f")


_SMOOTH = E + ", " + GRID + """, ax AS (SELECT lat, greatest(lat - 11.25, -90.0) AS a, least(lat + 11.25, 90.0) AS b FROM (SELECT DISTINCT lat FROM g)),
wl AS (SELECT s.lat AS lat, d.lat AS lat2, sin(radians(least(s.b, d.lat + 20.0, 90.0))) - sin(radians(greatest(s.a, d.lat - 20.0, -90.0))) AS wl FROM ax s JOIN ax d ON least(s.b, d.lat + 20.0) > greatest(s.a, d.lat - 20.0)),
lo AS (SELECT DISTINCT lon FROM g), ap AS (SELECT s.lon AS lon, d.lon AS lon2, ((s.lon - d.lon + 180 + 360) % 360) - 180 AS apart FROM lo s CROSS JOIN lo d),
wo AS (SELECT lon, lon2, least(apart + 22.5, 35.0) - greatest(apart - 22.5, -35.0) AS wo FROM ap WHERE least(apart + 22.5, 35.0) > greatest(apart - 22.5, -35.0)),
fm AS (SELECT member, t, lat, lon, CASE WHEN (cell + t) % 5 <> 0 THEN f END AS f FROM m JOIN g USING (cell)),
sm AS (SELECT member, t, lat2 AS lat, lon2 AS lon, sum(wl * wo * f) / sum(CASE WHEN f IS NOT NULL THEN wl * wo END) AS f FROM fm JOIN wl USING (lat) JOIN wo USING (lon) GROUP BY ALL)"""


@query(select(_SMOOTH, "sm", ["member", "t", "lat::DOUBLE AS lat", "lon::DOUBLE AS lon"], ["f"]))
def box_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ensembles.with_grid(ensembles.from_embeddings(spark, sf_dir)[0]).withColumn("f", F.when((F.col("cell") + F.col("t")) % 5 != 0, F.col("f")))
    return prepare.smooth_box(rows, LATS, LONS, (40.0, 70.0))


TO_LATS, TO_LONS = [-85.0, -30.0, 0.0, 45.0, 88.0], [0.0, 10.0, 100.0, 350.0]
_REGRID = E + ", " + GRID + f""", fm AS (SELECT member, t, lat, lon, f FROM m JOIN g USING (cell)), lo AS (SELECT DISTINCT lon FROM g),
px AS (SELECT * FROM fm UNION ALL SELECT member, t, 90.0, lo.lon, avg(f) FROM fm CROSS JOIN lo WHERE lat = 78.75 GROUP BY member, t, lo.lon UNION ALL SELECT member, t, -90.0, lo.lon, avg(f) FROM fm CROSS JOIN lo WHERE lat = -78.75 GROUP BY member, t, lo.lon),
py AS (SELECT * FROM px UNION ALL SELECT member, t, lat, 360.0, f FROM px WHERE lon = 0),
tl AS (SELECT UNNEST({TO_LONS})::DOUBLE AS lon2), e1 AS (SELECT member, t, lat, lon2, sum(f * (1 - abs(lon - lon2) / 45.0)) AS f FROM py JOIN tl ON abs(lon - lon2) < 45.0 GROUP BY ALL),
ax AS (SELECT lat, lead(lat) OVER (ORDER BY lat) AS up FROM (SELECT DISTINCT lat FROM py)), ta AS (SELECT lat2, lat, up FROM (SELECT UNNEST({TO_LATS})::DOUBLE AS lat2) JOIN ax ON lat <= lat2 AND lat2 < up),
e2 AS (SELECT a.member, a.t, lat2 AS lat, a.lon2 AS lon, a.f + (lat2 - ta.lat) / (ta.up - ta.lat) * (b.f - a.f) AS f FROM ta JOIN e1 a ON a.lat = ta.lat JOIN e1 b ON b.lat = ta.up AND b.member = a.member AND b.t = a.t AND b.lon2 = a.lon2)"""


@query(select(_REGRID, "e2", ["member", "t", "lat::DOUBLE AS lat", "lon::DOUBLE AS lon"], ["f"]))
def regrid_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ensembles.with_grid(ensembles.from_embeddings(spark, sf_dir)[0])
    return prepare.to_grid(rows, LATS, LONS, TO_LATS, TO_LONS)


@query(select(E, "(SELECT a.cell, a.member, a.t + 0.25 AS t, a.f + 0.25 * (b.f - a.f) AS f FROM m a JOIN m b ON a.cell = b.cell AND a.member = b.member AND b.t = a.t + 1)", ["cell", "member", "t::DOUBLE AS t"], ["f"]))
def time_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a given axis to another, where ``time_interpolation_whole`` goes by steps of the times there are."""
    rows = ensembles.from_embeddings(spark, sf_dir)[0].withColumn("t", F.col("t").cast("double"))
    axis = [float(t) for t in range(int(rows.agg(F.max("t")).first()[0] or 0) + 1)]
    return prepare.interpolate(rows, "t", axis, [t + 0.25 for t in axis[:-1]], ["cell", "member"])


@query(select(E, "(SELECT a.cell, a.member, a.t + 0.25 AS t, a.f + 0.25 * (b.f - a.f) AS f FROM m a JOIN m b ON a.cell = b.cell AND a.member = b.member AND b.t = a.t + 1)", ["cell", "member", "t::DOUBLE AS t"], ["f"]))
def time_interpolation_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each time to a quarter of the way to the next."""
    return prepare.interpolate_steps(ensembles.from_embeddings(spark, sf_dir)[0], "t", 0.25, ["cell", "member"])


@query(select(E + ", " + GRID, """(SELECT member, t, sum(CASE WHEN lat BETWEEN -40 AND 20 AND l2 BETWEEN -90 AND 50 THEN w * f END) / sum(CASE WHEN lat BETWEEN -40 AND 20 AND l2 BETWEEN -90 AND 50 THEN w END)
  - sum(CASE WHEN lat BETWEEN 30 AND 80 AND l2 BETWEEN -90 AND 50 THEN w * f END) / sum(CASE WHEN lat BETWEEN 30 AND 80 AND l2 BETWEEN -90 AND 50 THEN w END) AS index,
  count(*) FILTER (lat BETWEEN -40 AND 20 AND l2 BETWEEN -90 AND 50) AS cells_plus, count(*) FILTER (lat BETWEEN 30 AND 80 AND l2 BETWEEN -90 AND 50) AS cells_minus
  FROM (SELECT *, ((lon + 180) % 360) - 180 AS l2 FROM m JOIN g USING (cell)) GROUP BY member, t)""", ["member", "t"], ["index"], ["cells_plus", "cells_minus"]))
def box_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ensembles.with_grid(ensembles.from_embeddings(spark, sf_dir)[0])
    return area.box_index(rows, (-40, 20, -90, 50), (30, 80, -90, 50))
