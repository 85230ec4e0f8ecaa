"""Area-weighted summaries of maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwise.functions.scalar import FLOOR, ROUNDING, gauss_information


def mean(value: Column, weight: Column, where: Column | None = None) -> Column:
    """Weighted mean over known values (and where a condition holds)."""
    use = value.isNotNull() if where is None else value.isNotNull() & where
    return F.try_divide(F.sum(F.when(use, weight * value)), F.sum(F.when(use, weight)))


def share(condition: Column, weight: Column, valid: Column) -> Column:
    """Weighted share of the valid area where a condition holds."""
    return F.try_divide(F.sum(F.when(valid & F.coalesce(condition, F.lit(False)), weight).otherwise(0.0)), F.sum(F.when(valid, weight)))


def rule_row(bands: DataFrame, bins: DataFrame, grid: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per case: means, median relative band widths, and shares of the area by what the band over alts says of lambda.

    ``bands(by, cell, ...)`` as of ``information.band``; ``bins(by, cell, b_f, b_o, b_s)``; ``grid(cell, w)``.
    """
    rows = bands.join(bins, [*by, "cell"]).join(grid, "cell")
    c, w = F.col, F.col("w")
    valid = c("lam1").isNotNull()
    return rows.groupBy(*by).agg(
        mean(c("i_o1"), w).alias("i_o"), mean(c("i_m1"), w).alias("i_m"), mean(c("d_i_o"), w).alias("d_i_o"), mean(c("d_i_m"), w).alias("d_i_m"),
        F.percentile(F.try_divide("d_i_o", "i_o1"), F.lit(0.5)).alias("med_rel_d_i_o"), share(c("d_i_o") > c("i_o1"), w, c("i_o1").isNotNull()).alias("area_d_i_o_gt_i_o"),
        mean(c("lam1"), w).alias("lam"), mean(c("d_lam"), w).alias("d_lam"), share(c("lam1") > 1, w, valid).alias("area_lam_gt1"),
        share(c("low") > 1, w, valid).alias("area_band_gt1"), share(c("high") < 1, w, valid).alias("area_band_lt1"), share((c("low") <= 1) & (c("high") >= 1), w, valid).alias("area_band_contains1"),
        (1 - share(valid, w, c("i_o1").isNotNull())).alias("area_lam_undefined"),
        *[f(f"b_{a}").cast("long").alias(f"{n}_{a}") for a in "fos" for n, f in (("least", F.min), ("most", F.max))],
    )


def binning_row(points: DataFrame, loo_points: DataFrame, bands: DataFrame, grid: DataFrame, caps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per case of what ``rule_row`` leaves open: lambdas, bins, and the case with the others' mean as the signal.

    Area means of both lambdas at alt 1; the median relative width of i_m and the area where it exceeds i_m; of the bin counts of each axis the median, the share of cells
    with a single bin, and the share at the axis' cap (``caps(by, axis, cap)``; null without one); area means of i_o and i_m at each alt; and of ``loo_points`` at
    alt 1 the means of i_m, lambda of the model and the ratio, the area of a ratio above 1, and the median count of the signal's bins.
    """
    w, c, on = F.col("w"), F.col, [*by, "cell"]
    at = lambda alt: F.abs(F.col("alt") - alt) < 1e-9
    limit = caps.groupBy(*by).agg(*[F.max(F.when(c("axis") == a, c("cap"))).alias(f"_{a}") for a in "fos"])
    rows = points.join(grid, "cell")
    rows = rows.join(limit, list(by)) if by else rows.crossJoin(F.broadcast(limit))  # one row
    one = lambda v: F.when(at(1.0), v)
    middle = lambda v: F.percentile(v, F.lit(0.5))
    found = [mean(c(x), w, at(1.0)).alias(x) for x in ("lam_o", "lam_m")]
    for a in "fos":
        b = c(f"b_{a}")
        found += [F.floor(middle(one(b))).alias(f"median_{a}"), F.avg(one((b == 1).cast("double"))).alias(f"single_{a}"), F.avg(one((b >= c(f"_{a}")).cast("double"))).alias(f"capped_{a}")]
    found += [mean(c(i), w, at(alt)).alias(f"{i}_{name}") for i in ("i_o", "i_m") for alt, name in ((0.5, "half"), (1.0, "one"), (1.5, "more"))]
    wide = bands.join(grid, "cell").groupBy(*by).agg(
        middle(F.when(c("i_m1") > ROUNDING, c("d_i_m") / c("i_m1"))).alias("med_rel_d_i_m"), share(c("d_i_m") > c("i_m1"), w, c("i_m1").isNotNull()).alias("area_d_i_m_gt_i_m")
    )
    r = F.when(c("lam_m") > FLOOR, c("lam_o") / c("lam_m"))
    loo = loo_points.where(at(1.0)).join(grid, "cell").withColumn("r", r).groupBy(*by).agg(
        mean(c("i_m"), w).alias("loo_i_m"), mean(c("lam_m"), w).alias("loo_lam_m"), mean(c("r"), w).alias("loo_lam"), share(c("r") > 1, w, c("r").isNotNull()).alias("loo_area_lam_gt1"),
        F.floor(middle(c("b_s"))).alias("loo_median_s"),
    )
    out = rows.groupBy(*by).agg(*found)
    for part in (wide, loo):
        out = out.join(part, list(by)) if by else out.crossJoin(F.broadcast(part))  # one row each
    return out


def box_index(rows: DataFrame, plus: tuple[float, float, float, float], minus: tuple[float, float, float, float], by: Sequence[str] = ("member", "t"), value: str = "f") -> DataFrame:
    """(by, index, cells_plus, cells_minus): weighted mean of one box less that of another; boxes (south, north, west, east), inclusive.

    Longitudes count from -180.
    """
    lon = F.pmod(F.col("lon") + 180, F.lit(360.0)) - 180
    inside = lambda b: F.col("lat").between(b[0], b[1]) & lon.between(b[2], b[3])
    x, w = F.col(value), F.col("w")
    return rows.groupBy(*by).agg(
        (mean(x, w, inside(plus)) - mean(x, w, inside(minus))).alias("index"), F.count_if(inside(plus)).alias("cells_plus"), F.count_if(inside(minus)).alias("cells_minus")
    )


def spearman(maps: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, rho, same_class): rank correlation of two maps, and the share of cells on the same side of 1."""
    known = maps.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    rank = lambda c: F.rank().over(Window.partitionBy(*by).orderBy(c)) + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / 2
    ranked = known.withColumns({"_ra": rank(a), "_rb": rank(b), "_same": ((F.col(a) > 1) == (F.col(b) > 1)).cast("int")})
    spread = F.sqrt(F.var_pop("_ra") * F.var_pop("_rb"))
    return ranked.groupBy(*by).agg(F.when(spread > 0, F.covar_pop("_ra", "_rb") / spread).alias("rho"), F.avg("_same").alias("same_class"))


def class_shares(classes: DataFrame, grid: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, above, below, within): shares of the classified area whose interval lies above 1, below 1, or holds it."""
    rows = classes.join(grid, "cell")
    c, w, valid = F.col("class"), F.col("w"), F.col("class").isNotNull()
    return rows.groupBy(*by).agg(share(c == 1, w, valid).alias("above"), share(c == -1, w, valid).alias("below"), share(c == 0, w, valid).alias("within"))


def band_ranges(points: DataFrame, columns: int, value: str = "lam") -> DataFrame:
    """(cell, range): |value at alt 1.5 - at 0.5| of grid cells numbered row by row; edge columns take their neighbours' values."""
    at = lambda a: F.max(F.when(F.abs(F.col("alt") - a) < 1e-9, F.col(value)))
    inner = points.groupBy("cell").agg(F.abs(at(1.5) - at(0.5)).alias("range"))
    place = F.pmod(F.col("cell"), F.lit(columns))
    source = F.when(place == 0, F.col("cell") + 1).when(place == columns - 1, F.col("cell") - 1).otherwise(F.col("cell"))
    targets = inner.select("cell", source.alias("source"))
    return targets.join(inner.select(F.col("cell").alias("source"), "range"), "source").select("cell", "range")


def lambda_terms(points: DataFrame, loo_points: DataFrame, grid: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per case: lambda of the observations with the members and with the others' mean, and of the model.

    For each of the three the area mean at alt 1, its 10th and 90th percentiles over cells, and the area means at alt 0.5 and 1.5; for both ratios the mean and the
    share of the area above 1. ``points`` pairs members with observations, ``loo_points`` the others' mean; both as of ``information.point_estimates``.
    """
    on = [*by, "cell", "alt"]
    rows = points.select(*on, F.col("lam_o").alias("o_f"), F.col("lam_m").alias("m")).join(loo_points.select(*on, F.col("lam_o").alias("o_loo")), on).join(grid, "cell")
    w, at = F.col("w"), lambda alt: F.abs(F.col("alt") - alt) < 1e-9
    rows = rows.withColumns({f"ratio_{x}": F.when(F.col("m") > 0, F.col(f"o_{x}") / F.col("m")) for x in ("f", "loo")})
    found = []
    for c in ("o_f", "o_loo", "m"):
        p = F.percentile(F.when(at(1.0), F.col(c)), F.array(F.lit(0.1), F.lit(0.9)))
        found += [mean(F.col(c), w, at(a)).alias(f"lam_{c}{name}") for a, name in ((1.0, ""), (0.5, "_half"), (1.5, "_more"))] + [p[0].alias(f"lam_{c}_p10"), p[1].alias(f"lam_{c}_p90")]
    for x in ("f", "loo"):
        r = F.col(f"ratio_{x}")
        found += [mean(r, w, at(1.0)).alias(f"ratio_{x}"), share(r > 1, w, r.isNotNull() & at(1.0)).alias(f"ratio_{x}_gt1")]
    return rows.groupBy(*by).agg(*found)


def sweep_means(sweep: DataFrame, grid: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, b, i_o, i_m, lam): area means at each fixed bin count of ``information.fixed_sweep``."""
    w = F.col("w")
    return sweep.join(grid, "cell").groupBy(*by, "b").agg(*[mean(F.col(c), w).alias(c) for c in ("i_o", "i_m", "lam")])


def pooled_means(pooled: DataFrame, grid: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, rho_o, rho_m, rho_m_loo, ratio, gauss_i_o, gauss_i_m, area_ratio_gt1): area means of pooled correlations (``rho.pooled``) and of the information that they have."""
    c, w = F.col, F.col("w")
    means = {"rho_o": c("rho_o"), "rho_m": c("rho_m"), "rho_m_loo": c("rho_m_loo"), "ratio": F.try_divide("rho_o", "rho_m"), "gauss_i_o": gauss_information(c("rho_o")), "gauss_i_m": gauss_information(c("rho_m"))}
    return pooled.join(grid, "cell").groupBy(*by).agg(*[mean(v, w).alias(k) for k, v in means.items()], share(c("rho_o") > c("rho_m"), w, c("rho_o").isNotNull()).alias("area_ratio_gt1"))


def rule_difference(first: DataFrame, second: DataFrame, grid: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, d_i_o, d_i_m, d_lam, med_rel_i_o): area means of what two rules' ``information.band`` differ by at alt 1, and the median of the first relative difference."""
    on = [*by, "cell"]
    other = second.select(*on, *[F.col(k).alias(f"_{k}") for k in ("i_o1", "i_m1", "lam1")])
    rows, w = first.join(other, on).join(grid, "cell"), F.col("w")
    gap = lambda k: F.col(k) - F.col(f"_{k}")
    return rows.groupBy(*by).agg(*[mean(gap(k), w).alias(f"d_{n}") for k, n in (("i_o1", "i_o"), ("i_m1", "i_m"), ("lam1", "lam"))], F.percentile(F.try_divide(gap("i_o1"), F.col("i_o1")), F.lit(0.5)).alias("med_rel_i_o"))


def model_lambda_shares(points: DataFrame, as_obs: DataFrame, rho_o: DataFrame, grid: DataFrame) -> DataFrame:
    """(source, area_valid, area_rpc_gt1, lam_m, rpc) with the model's own lambda ("all") and with that of members as observations: each ("1", "2", ...) and their mean ("mean").

    Of cells with a positive ``rho_o(cell, rho_o)`` in which the ratios of the first and of the mean are defined: the share of the area where the observed
    lambda is larger, and the area means of the model's lambda and of the ratio. ``as_obs(cell, truth, lam_o)`` as of ``resample.member_as_obs``.
    """
    mean_ = as_obs.groupBy("cell").agg(F.avg("lam_o").alias("lam_mean"))
    cells = points.select("cell", "lam_o", "lam_m").join(mean_, "cell").join(rho_o.select("cell", "rho_o"), "cell").join(grid, "cell")
    valid = F.coalesce((F.col("rho_o") > 0) & (F.col("lam_m") > 0) & (F.col("lam_mean") > 0) & F.col("lam_o").isNotNull(), F.lit(False))
    cells = cells.withColumn("valid", valid)
    own = cells.select("cell", F.explode(F.array(F.struct(F.lit("all").alias("source"), F.col("lam_m").alias("lam")), F.struct(F.lit("mean").alias("source"), F.col("lam_mean").alias("lam")))).alias("x")).select("cell", "x.*")
    every = own.unionByName(as_obs.select("cell", F.col("truth").cast("string").alias("source"), F.col("lam_o").alias("lam")))
    rows = every.join(cells.select("cell", "lam_o", "valid", "w"), "cell").withColumn("r", F.when(F.col("lam") > 0, F.col("lam_o") / F.col("lam")))
    w, ok, r = F.col("w"), F.col("valid"), F.col("r")
    return rows.groupBy("source").agg(
        (F.sum(F.when(ok, w).otherwise(0.0)) / F.sum(w)).alias("area_valid"), share(r > 1, w, ok & r.isNotNull()).alias("area_rpc_gt1"), mean(F.col("lam"), w, ok).alias("lam_m"), mean(r, w, ok).alias("rpc")
    )


def zonal_shares(cells: DataFrame, grid: DataFrame, condition: Column, degrees: float = 30.0) -> DataFrame:
    """(band, share): of each band of latitudes, numbered from the south pole, the share of the area where a condition holds. ``grid(cell, lat, w)``."""
    rows = cells.join(grid, "cell").withColumn("band", F.floor((F.col("lat") + 90) / degrees).cast("int"))
    return rows.groupBy("band").agg(share(condition, F.col("w"), condition.isNotNull()).alias("share"))


def definition_summary(maps: DataFrame, grid: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per case of what two definitions of the model's lambda make of it, over the area of a positive rho_o.

    ``maps(by, cell, rho_o, lam_o, lam_m_avg, lam_m_pool)``: shares where a lambda is undefined, means of both and of their difference where both are defined, the
    share where the average is larger; and for the ratio by each the share of its area above 1, and the mean and median there.
    """
    c, rows = F.col, maps.join(grid, "cell")
    keep, both, w = c("rho_o") > 0, (c("rho_o") > 0) & c("lam_m_avg").isNotNull() & c("lam_m_pool").isNotNull(), c("w")
    found = [share(c(x).isNull(), w, keep).alias(f"area_{x}_undefined") for x in ("lam_o", "lam_m_pool")]
    found += [mean(v, w, both).alias(k) for k, v in (("lam_m_avg", c("lam_m_avg")), ("lam_m_pool", c("lam_m_pool")), ("avg_less_pool", c("lam_m_avg") - c("lam_m_pool")))]
    found.append(share(c("lam_m_avg") > c("lam_m_pool"), w, both).alias("share_avg_gt_pool"))
    for x in ("avg", "pool"):
        valid = keep & (c(f"lam_m_{x}") > 0) & c("lam_o").isNotNull()
        r = F.when(valid, c("lam_o") / c(f"lam_m_{x}"))
        found += [share(r > 1, w, valid).alias(f"rpc_{x}_gt1"), mean(r, w, r > 1).alias(f"rpc_{x}_mean"), F.percentile(F.when(r > 1, r), F.lit(0.5)).alias(f"rpc_{x}_median")]
    return rows.groupBy(*by).agg(*found)
