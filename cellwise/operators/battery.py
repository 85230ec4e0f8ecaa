"""Estimators of lambda side by side, on series of pairs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwise.functions.scalar import lambda_bits, lambda_nats, n_bins
from cellwise.operators import information, neighbours, series
from cellwise.operators.exchange import code_of

ESTIMATORS = ("knuth", "knuth_scores_3", "rank_bins", "rank_bins_bc", "gauss_copula", "ksg_scores", "ksg_raw")


def rank_information(pairs: DataFrame, by: Sequence[str], shifts: Sequence[int] = ()) -> DataFrame:
    """(by, mi[, null]) on equal-count bins, as many as ``n_bins`` says; null is the mean with y moved around by ``shifts`` places.

    ``pairs(by, t, x, y)`` with t counting from 0.
    """
    by = list(by)
    # one value a time and series: its sorted values give the linear quantiles, as many as its own length asks for
    series_ = pairs.groupBy(*by).agg(F.count("*").cast("int").alias("n"), n_bins(F.count("*")).alias("b"), F.array_sort(F.collect_list("x")).alias("_x"), F.array_sort(F.collect_list("y")).alias("_y"))

    def edges(values: str) -> Column:
        place = lambda k: (F.size(values) - 1) * (k / F.col("b"))
        low = lambda k: F.get(values, F.floor(place(k)).cast("int"))
        high = lambda k: F.get(values, F.least(F.floor(place(k)).cast("int") + 1, F.size(values) - 1))
        return F.transform(F.sequence(F.lit(1), F.col("b") - 1), lambda k: low(k) + (high(k) - low(k)) * (place(k) - F.floor(place(k))))

    cuts = series_.select(*by, "n", edges("_x").alias("_ex"), edges("_y").alias("_ey"))
    codes = pairs.join(cuts, by).select(*by, "t", "n", code_of(F.col("x"), F.col("_ex")).alias("cx"), code_of(F.col("y"), F.col("_ey")).alias("cy"))
    moved = codes.select(*by, "n", "cy", F.col("t").alias("_from")).withColumn("shift", F.explode(F.array(*map(F.lit, [0, *shifts]))))
    moved = moved.withColumn("t", F.pmod(F.col("_from") + F.col("shift"), F.col("n")).cast("int")).drop("_from", "n")
    found = information.entropies(codes.select(*by, "t", "cx").join(moved, [*by, "t"]), [*by, "shift"])
    out = [F.max(F.when(F.col("shift") == 0, F.col("mi"))).alias("mi"), *([F.avg(F.when(F.col("shift") != 0, F.col("mi"))).alias("null")] if shifts else [])]
    return found.groupBy(*by).agg(*out)


def estimates(pairs: DataFrame, by: Sequence[str], shifts: Sequence[int], most: int = information.KNUTH_MOST) -> DataFrame:
    """(by, estimator, lam) of ``pairs(by, t, x, y)``: Knuth's bins on values and (at least 3) on scores, equal-count bins plain and less
    their null, the Gaussian copula, and nearest neighbours on scores and on values."""
    by = list(by)
    scored = information.normal_scores(information.normal_scores(pairs, "x", by, "zx"), "y", by, "zy")

    def knuth(x: str, y: str, least: int) -> DataFrame:
        bins = [information.knuth_counts(scored, c, by, most, name) for c, name in ((x, "bx"), (y, "by_"))]
        sized = bins[0].join(bins[1], by).select(*by, *[F.greatest(F.col(c), F.lit(least)).alias(c) for c in ("bx", "by_")])
        return information.histogram_information(scored, sized, by, by, x, y).select(*by, lambda_bits(F.col("mi")).alias("lam"))

    ranked = rank_information(pairs, by, shifts)
    spread = F.sqrt(F.var_pop("zx") * F.var_pop("zy"))
    nearest = lambda x, y: neighbours.ksg_information(scored.select(*by, F.col(x).alias("x"), F.col(y).alias("y")), by).select(*by, lambda_nats(F.col("mi")).alias("lam"))
    found = [
        knuth("x", "y", 1), knuth("zx", "zy", 3), ranked.select(*by, lambda_bits(F.col("mi")).alias("lam")), ranked.select(*by, lambda_bits(F.col("mi") - F.col("null")).alias("lam")),
        scored.groupBy(*by).agg(F.abs(F.when(spread > 0, F.covar_pop("zx", "zy") / spread)).alias("lam")), nearest("zx", "zy"), nearest("x", "y"),
    ]
    out = None
    for name, df in zip(ESTIMATORS, found):
        part = df.select(*by, F.lit(name).alias("estimator"), "lam")
        out = part if out is None else out.unionByName(part)
    return out


def prefix_sizes(members: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """The ensembles of the first members of each of ``sizes``, as key ``size``: members counted from 0 in their order."""
    order = members.select("member").distinct().withColumn("_place", F.expr("row_number() OVER (ORDER BY member)"))  # a row per member
    sized = order.withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).where("_place <= size").select("member", "size")
    return members.join(F.broadcast(sized), "member")


def evenly_spaced(members: DataFrame, count: int) -> DataFrame:
    """``count`` members evenly spaced over their order, ends included; places round half to even, and equal places count once."""
    order = members.select("member").distinct().withColumn("_place", F.expr("row_number() OVER (ORDER BY member) - 1"))  # a row per member
    last = order.agg((F.count("*") - 1).alias("_last"))
    k = F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    places = last.select(F.expr("_last"), k.alias("_k")).select(F.bround(F.col("_k") * F.col("_last") / max(1, count - 1)).cast("int").alias("_place")).distinct()
    return members.join(F.broadcast(order.join(places, "_place").select("member")), "member", "left_semi")


def models_in_order(labels: DataFrame) -> DataFrame:
    """(model, first, members): models in the order of their first member."""
    return labels.groupBy("model").agg(F.min("member").alias("first"), F.count("*").alias("members")).orderBy("first")


def in_box(rows: DataFrame, south: float, north: float, west: float, east: float) -> DataFrame:
    """Rows of an inclusive box; longitudes count from -180."""
    lon = F.pmod(F.col("lon") + 180, F.lit(360.0)) - 180
    return rows.where(F.col("lat").between(south, north) & lon.between(west, east))


def tiling(pairs: DataFrame, tiles: Sequence[int], by: Sequence[str] = ("cell",)) -> DataFrame:
    """(by, tiles, bins_x, bins_y, h_x, h_fixed, mi) of series ``pairs(by, t, x, y)`` repeated ``tiles`` times: what tiling alone does to bins, entropy and information.

    Bins are Freedman and Diaconis' of the repeated values, ``h_fixed`` is the entropy of x in the bins of the series itself. A repeated value is one of more weight, so
    no row is copied; a series, one value a time, is done in one task. Rows without x or y are left out; where the rule gives no count, the values are null.
    """
    by = list(by)
    known = pairs.select(*by, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")

    def tiled(frame: pd.DataFrame) -> pd.DataFrame:
        x, y = frame["x"].to_numpy(), frame["y"].to_numpy()
        own = series.freedman_diaconis(x, np.ones(len(x), np.int64))
        entropy = lambda v, bins, w: None if not bins else series.information(c := series.codes(v, bins), c, w)
        rows = []
        for n in tiles:
            w = np.full(len(x), n, np.int64)
            a, b = (series.freedman_diaconis(v, w) for v in (x, y))
            mi = series.information(series.codes(x, a), series.codes(y, b), w) if a and b else None
            rows.append((n, a, b, entropy(x, a, w), entropy(x, own, w), mi))
        out = pd.DataFrame(rows, columns=["tiles", "bins_x", "bins_y", "h_x", "h_fixed", "mi"]).astype({"bins_x": "Int32", "bins_y": "Int32"})
        for i, c in enumerate(by):
            out.insert(i, c, frame[c].iloc[0])
        return out

    keys = ", ".join(f"{c} {dict(known.dtypes)[c]}" for c in by)
    return known.groupBy(*by).applyInPandas(tiled, f"{keys}, tiles int, bins_x int, bins_y int, h_x double, h_fixed double, mi double")
