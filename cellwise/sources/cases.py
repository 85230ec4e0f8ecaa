"""Cases: from the files of several models to one ensemble and its observations."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellwise.operators import prepare
from cellwise.sources import catalog

#: The calendar month of lead 1 of most models; their observations stand for a pool's.
REFERENCE_INIT = 11


def wanted_months(windows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, t): the months of all windows (by, w_lo, w_hi), each once."""
    return windows.select(*by, F.explode(F.sequence("w_lo", "w_hi")).alias("t")).distinct()


def covering(members: DataFrame, windows: DataFrame, on: Sequence[str] = ("model",)) -> DataFrame:
    """Of ``members(on, ..., lo, hi)`` those whose files reach from the first to the last month of their ``windows(on, w_lo, w_hi)``."""
    ends = windows.groupBy(*on).agg(F.min("w_lo").alias("_lo"), F.max("w_hi").alias("_hi"))
    return members.join(ends, list(on)).where((F.col("lo") <= F.col("_lo")) & (F.col("hi") >= F.col("_hi"))).select(members.columns)


def window_means(files: DataFrame, values: DataFrame, windows: DataFrame, by: Sequence[str], on: Sequence[str] = ("model",), cell: Sequence[str] = ("cell",)) -> DataFrame:
    """(by, init, lead_from, lead_to, cell, f): unweighted means over the months of each window; one scan of the values serves all windows.

    ``files(by, title, lo, hi)`` whose span meets no window of the same ``on`` are not joined; ``values(title, cell, t, f)`` are monthly;
    ``windows(on, init, lead_from, lead_to, w_lo, w_hi)``. A window that lacks a month, or has one twice, gives no row.
    """
    keys = [*by, "init", "lead_from", "lead_to", *cell]
    needed = catalog.overlapping(files.select("title", *by, "lo", "hi"), windows, on).drop("lo", "hi")
    rows = values.select("title", *cell, "t", "f").join(needed, "title").where(F.col("t").between(F.col("w_lo"), F.col("w_hi")) & F.col("f").isNotNull())
    months = F.max(F.col("w_hi") - F.col("w_lo") + 1)
    found = rows.groupBy(*keys).agg(F.avg("f").alias("f"), F.count("*").alias("_n"), F.size(F.collect_set("t")).alias("_t"), months.alias("_m"))
    return found.where("_n = _m AND _t = _m").select(*keys, "f")


def require_windows(means: DataFrame, members: DataFrame, windows: DataFrame, by: Sequence[str], on: Sequence[str] = ("model",)) -> DataFrame:
    """``means`` of ``window_means``, or an error if one of the ``members(by)`` lacks a window of its ``on``."""
    keys = [*by, "init", "lead_from", "lead_to"]
    expected = members.select(*by).distinct().join(windows, list(on)).select(*keys)
    lacking = expected.join(means, keys, "left_anti").limit(5).collect()
    if lacking:
        raise ValueError(f"months lack in windows such as {lacking}")
    return means


def monthly_series(files: DataFrame, values: DataFrame, want: DataFrame, by: Sequence[str], cell: Sequence[str] = ("cell",)) -> DataFrame:
    """(by, cell, t, f): the months of ``want(pos, t)`` at their places, of those members whose files span them all; an error if one lacks within the span."""
    ends = want.agg(F.min("t").alias("w_lo"), F.max("t").alias("w_hi"), F.count_distinct("t").alias("_m"))
    spans = files.groupBy(*by).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    whole = spans.join(F.broadcast(ends), (F.col("lo") <= F.col("w_lo")) & (F.col("hi") >= F.col("w_hi")))  # one row
    needed = files.where("hi >= lo").join(whole.select(*by, "w_lo", "w_hi", "_m"), list(by)).where("lo <= w_hi AND hi >= w_lo")
    rows = values.select("title", *cell, F.col("t"), "f").join(needed.select("title", *by, "_m"), "title").join(want, "t")
    short = rows.where("f IS NOT NULL").groupBy(*by, *cell).agg(F.count_distinct("t").alias("_n"), F.max("_m").alias("_m")).where("_n < _m").limit(5).collect()
    if short:
        raise ValueError(f"months lack within the span of {short}")
    return rows.select(*by, *cell, F.col("pos").alias("t"), "f")


def members_of(rows: DataFrame) -> DataFrame:
    """(model, name, member): the pool's numbers of the models' members, in order of model and name; a row per member."""
    names = rows.select("model", "name").distinct()
    return names.withColumn("member", F.row_number().over(Window.orderBy("model", "name")).cast("int"))


def build_ensemble(runs: Mapping[str, tuple[DataFrame, Sequence[float], Sequence[float]]], lats: Sequence[float], lons: Sequence[float]) -> DataFrame:
    """(name, member, t, lat, lon, f): runs(t, lat, lon, f), each with its own axes, on the template's ``lats`` and ``lons``, numbered from 0 in the order given.

    Linear along both axes; nothing is extrapolated, so points beyond a run's grid, or beside a missing value, have no row.
    """
    parts = []
    for n, (name, (rows, own_lats, own_lons)) in enumerate(runs.items()):  # a plan per run, as each has a grid of its own
        along = prepare.interpolate(rows.select("t", "lat", "lon", "f"), "lat", own_lats, lats, ["t", "lon"])
        on_grid = prepare.interpolate(along, "lon", own_lons, lons, ["t", "lat"])
        parts.append(on_grid.select(F.lit(name).alias("name"), F.lit(n).alias("member"), "t", "lat", "lon", "f"))
    return reduce(DataFrame.unionByName, parts)


def common_years(members: DataFrame, obs: DataFrame, require_obs: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """(year, t) of the start years that every model has, numbered in order; and (model, dropped), how many of its years the others lack.

    A year counts for a model where it is observed, if the model has any observation (or if ``require_obs`` says so either way).
    """
    years = members.select("model", "year").distinct()
    seen = years.join(obs.where("o IS NOT NULL").select("model", "year", F.lit(True).alias("_seen")).distinct(), ["model", "year"], "left")
    wants = F.max(F.coalesce("_seen", F.lit(False))).over(Window.partitionBy("model")) if require_obs is None else F.lit(require_obs)
    kept = seen.withColumn("_wants", wants).where(~F.col("_wants") | F.col("_seen")).select("model", "year")
    common = catalog.common_keys(kept, "year", "model")
    dropped = kept.groupBy("model").agg(F.count("*").alias("_all")).join(kept.join(common, "year").groupBy("model").agg(F.count("*").alias("_in")), "model", "left")
    order = F.row_number().over(Window.orderBy("year")) - 1  # a row per start year
    return common.withColumn("t", order.cast("int")), dropped.select("model", (F.col("_all") - F.coalesce("_in", F.lit(0))).alias("dropped"))


def pooled(members: DataFrame, obs: DataFrame, inits: DataFrame, cell: Sequence[str] = ("cell",), require_obs: bool | None = None, detrended: bool = True, reference: int = REFERENCE_INIT) -> tuple[DataFrame, DataFrame]:
    """One ensemble of several models' start years: (cell, model, member, t, f) and (cell, t, o).

    ``members(model, name, year, cell, f)`` and ``obs(model, year, cell, o)`` are cut to the common years and detrended by member; ``inits(model, init_month)``.
    Observations are those of the first model that begins in the reference month, else of the first.
    """
    years = F.broadcast(common_years(members, obs, require_obs)[0])  # a row per start year
    numbers = F.broadcast(members_of(members))  # a row per member
    f = members.join(years, "year").join(numbers, ["model", "name"]).select(*cell, "model", "member", "t", "f")
    first = inits.select(F.min_by("model", F.struct(F.coalesce(F.col("init_month") != reference, F.lit(True)), "model")).alias("model"))
    o = obs.join(F.broadcast(first), "model").join(years, "year").select(*cell, "t", "o")  # one row
    if not detrended:
        return f, o
    return prepare.detrend(f, [*cell, "member"]), prepare.detrend(o, cell, "o")


def decade(members: DataFrame, obs: DataFrame, cell: Sequence[str] = ("cell",), anomalies: str = "moy", detrended: bool = True) -> tuple[DataFrame, DataFrame]:
    """One start's months of several models as one ensemble: (cell, model, member, t, f) and (cell, t, o), t the absolute month.

    With ``moy`` each model loses its own mean of every calendar month, over its members and years, and the observations theirs; then every member its line.
    """
    if anomalies not in ("moy", "none"):
        raise ValueError("anomalies must be 'moy' or 'none'")
    f = members.join(F.broadcast(members_of(members)), ["model", "name"]).select(*cell, "model", "member", "t", "f")  # a row per member
    o = obs.select(*cell, "t", "o")
    if anomalies == "moy":
        moy = F.pmod(F.col("t"), F.lit(12))
        f = prepare.without_season(f.withColumn("moy", moy), "moy", [*cell, "model"]).drop("moy")
        o = prepare.without_season(o.withColumn("moy", moy), "moy", cell, "o").drop("moy")
    if not detrended:
        return f, o
    return prepare.detrend(f, [*cell, "member"]), prepare.detrend(o, cell, "o")


@dataclass(frozen=True)
class Case:
    """What the name of a case asks for."""

    kind: str  # cmip5, decade or window
    model: str | None = None
    start: int | None = None
    anomalies: str = "none"
    lead: str | None = None


def parse_case(name: str) -> Case:
    """cmip5; s1961 or s1961moy (a decade of months); 2-4 (a lead window, all models) or CanESM5_2-4 (of one model)."""
    if name == "cmip5":
        return Case("cmip5")
    if name.startswith("s") and name[1:5].isdigit():
        return Case("decade", start=int(name[1:5]), anomalies="moy" if name.endswith("moy") else "none")
    model, _, lead = name.rpartition("_")
    return Case("window", model or None, lead=lead)


def load(name: str, sources: Mapping[str, Callable[[Case], tuple[DataFrame, DataFrame]]]) -> tuple[DataFrame, DataFrame]:
    """Members and observations of a named case, from the source of its kind; the members of one model alone if the name says so."""
    case = parse_case(name)
    members, obs = sources[case.kind](case)
    return (members.where(F.col("model") == case.model) if case.model else members), obs


def require_aligned(anomalies: DataFrame, base: DataFrame, by: Sequence[str] = ("cell",), tolerance: float = 1e-6) -> DataFrame:
    """``anomalies(by, member, t, f)``, or an error unless they differ from ``base`` by one series that all members share.

    So the labels of the one's members hold for the other's.
    """
    gaps = anomalies.select(*by, "member", "t", "f").join(base.select(*by, "member", "t", F.col("f").alias("_base")), [*by, "member", "t"], "full")
    spread = gaps.groupBy(*by, "t").agg((F.max(F.col("f") - F.col("_base")) - F.min(F.col("f") - F.col("_base"))).alias("spread"), F.count_if(F.col("f").isNull() != F.col("_base").isNull()).alias("alone"))
    found = spread.agg(F.max("spread").alias("spread"), F.sum("alone").alias("alone")).crossJoin(anomalies.agg(F.max(F.abs("f")).alias("most"))).first()  # one row each
    if found["alone"] or (found["spread"] or 0.0) > tolerance * max(1.0, found["most"] or 0.0):
        raise ValueError(f"members do not line up: {found['alone'] or 0} rows in one of them only, and a spread of {found['spread']}")
    return anomalies
