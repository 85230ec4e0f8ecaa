"""Detrending, anomalies, interpolation and smoothing."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def detrend(rows: DataFrame, by: Sequence[str] = ("cell", "member"), value: str = "f", time: str = "t", least: int = 1) -> DataFrame:
    """``value`` without its least-squares line in ``time`` per series; missing values stay missing and don't count.

    A series of fewer than ``least`` known values becomes missing. Lines come from one aggregation, joined back.
    """
    known = F.when(F.col(value).isNotNull(), F.col(time).cast("double"))
    slope = F.coalesce(F.try_divide(F.covar_pop(value, known), F.var_pop(known)), F.lit(0.0))
    lines = rows.groupBy(*by).agg(slope.alias("_slope"), F.avg(value).alias("_mean"), F.avg(known).alias("_time"), F.count(value).alias("_n"))
    joined = rows.join(lines, list(by))
    line = F.col("_mean") + F.col("_slope") * (F.col(time) - F.col("_time"))
    return joined.withColumn(value, F.when(F.col("_n") >= least, F.col(value) - line)).select(rows.columns)


def detrend_by_season(rows: DataFrame, season: str, by: Sequence[str] = ("cell", "member"), value: str = "f", time: str = "t", least: int = 1) -> DataFrame:
    """``detrend`` within each season, over the position of a time within it, so the seasonal mean goes too."""
    place = F.row_number().over(Window.partitionBy(*by, season).orderBy(time))
    return detrend(rows.withColumn("_place", place), [*by, season], value, "_place", least).drop("_place")


def without_season(rows: DataFrame, season: str, by: Sequence[str] = ("cell",), value: str = "f") -> DataFrame:
    """Anomalies from the mean of each season over all times and members of a group (of one model, say)."""
    means = rows.groupBy(*by, season).agg(F.avg(value).alias("_mean"))
    return rows.join(means, [*by, season]).withColumn(value, F.col(value) - F.col("_mean")).select(rows.columns)


def without_global_mean(rows: DataFrame, by: Sequence[str] = ("member", "t"), value: str = "f", weight: str = "w") -> DataFrame:
    """Each map less its area-weighted mean over known cells."""
    known = F.when(F.col(value).isNotNull(), F.col(weight))
    means = rows.groupBy(*by).agg(F.try_divide(F.sum(F.col(weight) * F.col(value)), F.sum(known)).alias("_mean"))
    return rows.join(means, list(by)).withColumn(value, F.col(value) - F.col("_mean")).select(rows.columns)


#: The sides of the smoothing box in degrees of latitude and longitude, by variable.
BOX, BOX_BY_VAR = (11.25, 12.5), {"TREFHT": (15.0, 15.0)}


def box_for(var: str) -> tuple[float, float]:
    return BOX_BY_VAR.get(var, BOX)


def _edges(axis: Sequence[float]) -> list[tuple[float, float]]:
    """Lower and upper edge of each cell: midpoints, and half a step beyond the ends."""
    if len(axis) == 1:
        return [(axis[0] - 0.5, axis[0] + 0.5)]
    mid = [(a + b) / 2 for a, b in zip(axis, axis[1:])]
    ends = [2 * axis[0] - mid[0], *mid, 2 * axis[-1] - mid[-1]]
    return list(zip(ends, ends[1:]))


def lat_overlaps(lats: Sequence[float], size: float) -> list[tuple[float, float, float]]:
    """(from, to, weight): how much of the box around latitude ``to`` each row covers, as a difference of sines."""
    limit = lambda x: min(90.0, max(-90.0, x))
    out = []
    for to in lats:
        for source, (low, high) in zip(lats, _edges(lats)):
            a, b = max(limit(low), limit(to - size / 2)), min(limit(high), limit(to + size / 2))
            if b > a:
                out.append((source, to, math.sin(math.radians(b)) - math.sin(math.radians(a))))
    return out


def lon_overlaps(lons: Sequence[float], size: float) -> list[tuple[float, float, float]]:
    """(from, to, weight): overlap of the box around longitude ``to`` with each column, around the globe, in degrees."""
    out = []
    for to in lons:
        for source, (low, high) in zip(lons, _edges(lons)):
            apart, half = (source - to + 180) % 360 - 180, (high - low) / 2
            overlap = min(apart + half, size / 2) - max(apart - half, -size / 2)
            if overlap > 0:
                out.append((source, to, overlap))
    return out


def smooth_box(rows: DataFrame, lats: Sequence[float], lons: Sequence[float], size: tuple[float, float], by: Sequence[str] = ("member", "t"), value: str = "f") -> DataFrame:
    """(by, lat, lon, value): area-weighted means over boxes around each grid point, known values only.

    The box separates, so there are two passes, each a join with the overlaps of one axis (a table of the grid's size) and a sum.
    """
    spark = rows.sparkSession
    out = rows.select(*by, "lat", "lon", F.coalesce(value, F.lit(0.0)).alias("z"), F.col(value).isNotNull().cast("double").alias("m"))
    for axis, table in (("lon", lon_overlaps(lons, size[1])), ("lat", lat_overlaps(lats, size[0]))):
        weights = spark.createDataFrame(table, f"{axis} double, to double, weight double")
        other = "lat" if axis == "lon" else "lon"
        out = out.join(F.broadcast(weights), axis).groupBy(*by, other, F.col("to").alias(axis)).agg(F.sum(F.col("weight") * F.col("z")).alias("z"), F.sum(F.col("weight") * F.col("m")).alias("m"))
    return out.select(*by, "lat", "lon", F.when(F.col("m") > 0, F.col("z") / F.col("m")).alias(value))


def axis_weights(source: Sequence[float], target: Sequence[float], extrapolate: bool = False) -> list[tuple[float, float, float]]:
    """(from, to, weight) of linear interpolation; beyond the ends nothing, or the end segments' lines."""
    out = []
    for x in target:
        if not extrapolate and not source[0] <= x <= source[-1]:
            continue
        k = max(0, min(len(source) - 2, sum(s <= x for s in source) - 1))
        part = (x - source[k]) / (source[k + 1] - source[k])
        out += [(source[j], x, w) for j, w in ((k, 1 - part), (k + 1, part)) if w]
    return out


def interpolate(rows: DataFrame, axis: str, source: Sequence[float], target: Sequence[float], by: Sequence[str], value: str = "f", extrapolate: bool = False) -> DataFrame:
    """(by, axis, value) at ``target``; a point is missing if a value that it needs is."""
    weights = rows.sparkSession.createDataFrame(axis_weights(source, target, extrapolate), f"{axis} double, to double, weight double")
    needs = weights.groupBy("to").agg(F.count("*").alias("needs"))
    joined = rows.where(F.col(value).isNotNull()).join(F.broadcast(weights), axis).groupBy(*by, "to").agg(F.sum(F.col("weight") * F.col(value)).alias(value), F.count("*").alias("has"))
    return joined.join(F.broadcast(needs), "to").where("has = needs").select(*by, F.col("to").alias(axis), value)


def interpolate_steps(rows: DataFrame, axis: str, part: float, by: Sequence[str], value: str = "f") -> DataFrame:
    """(by, axis, value) at ``part`` of the way from every whole step of the table's own axis to the next; missing if either end is.

    Each value goes to the two points that need it, so the axis may have any length and no row meets another in a join.
    """
    at, x = F.col(axis).cast("double"), F.col(value)
    ends = F.array(F.struct((at + part).alias("to"), (x * (1 - part)).alias("v")), F.struct((at - 1 + part).alias("to"), (x * part).alias("v")))
    sums = rows.where(x.isNotNull()).select(*by, F.inline(ends)).groupBy(*by, "to").agg(F.sum("v").alias(value), F.count("*").alias("has"))
    return sums.where("has = 2").select(*by, F.col("to").alias(axis), value)


def to_grid(rows: DataFrame, lats: Sequence[float], lons: Sequence[float], to_lats: Sequence[float], to_lons: Sequence[float], by: Sequence[str] = ("member", "t"), value: str = "f") -> DataFrame:
    """Bilinear values on another grid: longitudes go round, and each pole is the mean of the row next to it."""
    poles = [(90.0, lats[-1]), (-90.0, lats[0])]
    parts = [rows.select(*by, "lat", "lon", value)]
    for pole, row in poles:
        if abs(row) < 90:
            mean = rows.where(F.col("lat") == row).groupBy(*by).agg(F.avg(value).alias(value))
            parts.append(mean.select(*by, F.lit(pole).alias("lat"), F.explode(F.array(*map(F.lit, lons))).alias("lon"), value))
    full = parts[0]
    for part in parts[1:]:
        full = full.unionByName(part)
    around = full.where(F.col("lon") == lons[0]).withColumn("lon", F.col("lon") + 360).unionByName(full).unionByName(full.where(F.col("lon") == lons[-1]).withColumn("lon", F.col("lon") - 360))
    lat_axis = [*([-90.0] if lats[0] > -90 else []), *lats, *([90.0] if lats[-1] < 90 else [])]
    east = interpolate(around, "lon", [lons[-1] - 360, *lons, lons[0] + 360], to_lons, [*by, "lat"], value)
    return interpolate(east, "lat", lat_axis, to_lats, [*by, "lon"], value)
