"""Histograms, entropies, mutual information and the lambda built on them."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellwise.functions.scalar import bin_of, fd_bins, lambda_bits
from cellwise.functions.special import normal_quantile
from cellwise.operators import series
from cellwise.operators.pairs import with_means

KNUTH_MOST = 200
ALTS = (0.5, 1.0, 1.5)


def entropies(codes: DataFrame, by: Sequence[str], x: str = "cx", y: str = "cy") -> DataFrame:
    """(by, n, h_x, h_y, h_xy, mi) in bits from integer codes: rows become joint counts once, margins come from those."""
    joint = codes.groupBy(*by, x, y).agg(F.count("*").alias("c"))
    keys = [F.col(k) for k in (*by, x, y)]
    sets = [[*map(F.col, by), *margin] for margin in ([F.col(x), F.col(y)], [F.col(x)], [F.col(y)])]
    counts = joint.groupingSets(sets, *keys).agg(F.sum("c").alias("c"), F.grouping(x).alias("no_x"), F.grouping(y).alias("no_y"))
    term = F.col("c") * F.log2("c")
    both = (F.col("no_x") == 0) & (F.col("no_y") == 0)
    sums = counts.groupBy(*by).agg(
        F.sum(F.when(both, F.col("c"))).alias("n"),
        F.sum(F.when(both, term)).alias("xy"),
        F.sum(F.when(F.col("no_y") == 1, term)).alias("x"),
        F.sum(F.when(F.col("no_x") == 1, term)).alias("y"),
    )
    h = lambda part: F.log2("n") - F.col(part) / F.col("n")
    out = sums.select(*by, "n", h("x").alias("h_x"), h("y").alias("h_y"), h("xy").alias("h_xy"))
    return out.withColumn("mi", F.col("h_x") + F.col("h_y") - F.col("h_xy"))


def histogram_information(pairs: DataFrame, bins: DataFrame, by: Sequence[str], on: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """``entropies`` of equal-width bins over each group's own range.

    ``bins(on, ..., bx, by_)`` has the counts; its further columns come out as keys. ``on`` are the keys of pairs and bins in common.
    """
    known = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    extent = known.groupBy(*on).agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    joined = known.join(bins.where("bx IS NOT NULL AND by_ IS NOT NULL").join(extent, list(on)), list(on))
    coded = joined.select(*by, bin_of(F.col(x), F.col("x0"), F.col("x1"), F.col("bx")).alias("cx"), bin_of(F.col(y), F.col("y0"), F.col("y1"), F.col("by_")).alias("cy"))
    return entropies(coded, by)


def fd_counts(rows: DataFrame, value: str, by: Sequence[str], name: str = "bins") -> DataFrame:
    """(by, bins): Freedman-Diaconis."""
    quartiles = F.percentile(value, F.array(F.lit(0.25), F.lit(0.75)))
    return rows.groupBy(*by).agg(fd_bins(F.max(value) - F.min(value), quartiles, F.count(value)).alias(name))


def knuth_counts(rows: DataFrame, value: str, by: Sequence[str], most: int = KNUTH_MOST, name: str = "bins", chunk: int = 1_000_000) -> DataFrame:
    """(by, bins): the count of the greatest posterior (Knuth), of 1 to ``most`` and no more than there are values; first of equals.

    Equal values are counted, the others sorted once and searched for the edges of all counts, so no row meets a candidate. Groups of more than ``chunk`` distinct
    values are dealt over tasks, and only their sums, some ``most``^2 / 2 numbers each, come together, in two steps. Missing values are left out; a group without any
    doesn't come out.
    """
    by = list(by)
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_x")).agg(F.count("*").alias("_w"))
    extent = counts.groupBy(*by).agg(F.min("_x").alias("_low"), F.max("_x").alias("_high"), F.sum("_w").alias("_n"), F.ceil(F.count("*") / chunk).alias("_parts"))
    dealt = counts.join(extent, by).withColumn("_part", F.pmod(F.xxhash64("_x"), F.col("_parts")))
    keys = ", ".join(f"{c} {dict(counts.dtypes)[c]}" for c in by)

    def searched(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_x")
        low, high, n, parts = (frame[c].iloc[0] for c in ("_low", "_high", "_n", "_parts"))
        below = series.below_edges(frame["_x"].to_numpy(), frame["_w"].to_numpy(), low, high, min(int(n), most))
        out = frame[[*by, "_n", "_part"]][:1].copy()
        out["_best"] = pd.array([series.knuth_best(below, int(n), min(int(n), most)) if parts == 1 else None], "Int32")
        out["_below"] = None if parts == 1 else below.tobytes()
        return out

    total = lambda parts: np.sum([np.frombuffer(b, np.int64) for b in parts], axis=0)

    @F.pandas_udf("binary")
    def added(below: pd.Series) -> pd.Series:
        return below.map(lambda parts: total(parts).tobytes() if len(parts) else None)

    @F.pandas_udf("int")
    def best(below: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([series.knuth_best(total(parts), size, min(size, most)) if len(parts) else None for parts, size in zip(below, n.tolist())], dtype="Int32")

    found = dealt.groupBy(*by, "_part").applyInPandas(searched, f"{keys}, _n long, _part long, _best int, _below binary")
    together = [F.max("_n").alias("_n"), F.max("_best").alias("_best"), F.collect_list("_below").alias("_below")]
    some = found.groupBy(*by, (F.col("_part") % 1024).alias("_part")).agg(*together).withColumn("_below", added("_below"))
    return some.groupBy(*by).agg(*together).select(*by, F.coalesce("_best", best("_below", "_n")).alias(name))


def thesis_knuth_counts(rows: DataFrame, value: str, by: Sequence[str], most: int = KNUTH_MOST) -> DataFrame:
    """The older rule: counts below ``most``, and one more than the best unless that is 1."""
    best = knuth_counts(rows, value, by, most - 1)
    return best.withColumn("bins", F.when(F.col("bins") > 1, F.col("bins") + 1).otherwise(1))


def normal_scores(rows: DataFrame, value: str, by: Sequence[str], name: str) -> DataFrame:
    """Add the normal score of ``value`` within ``by``: the quantile of (average rank - 1/2) / n; missing stays missing."""
    known = F.col(value).isNotNull()
    group = [*map(F.col, by), known]
    rank = F.rank().over(Window.partitionBy(*group).orderBy(value)) + (F.count("*").over(Window.partitionBy(*group, F.col(value))) - 1) / 2
    ranked = rows.withColumn("_share", (rank - 0.5) / F.count("*").over(Window.partitionBy(*group)))
    return ranked.withColumn(name, F.when(known, normal_quantile(F.col("_share")))).drop("_share")


def spread_scores(rows: DataFrame, value: str, by: Sequence[str], name: str, parts: int = 1024) -> DataFrame:
    """As ``normal_scores``, where a group may hold a large part of all rows; null keys have no score.

    Ranks come from counts of distinct values: those in lower parts of the group's range (``parts`` equal ones, a row each), and those below within the part.
    """
    by, x = list(by), F.col(value)
    counts = rows.where(x.isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    ends = counts.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.sum("_c").alias("_n"))
    part = F.least(F.floor(F.coalesce(F.try_divide(x - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)) * parts), F.lit(parts - 1))
    placed = counts.join(ends, by).withColumn("_part", part)
    totals = placed.groupBy(*by, "_part").agg(F.sum("_c").alias("_s"))
    lower = F.sum("_s").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    before = totals.select(*by, "_part", F.coalesce(lower, F.lit(0)).alias("_before"))
    within = F.sum("_c").over(Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")
    share = (F.col("_before") + within + F.col("_c") / 2) / F.col("_n")
    ranks = placed.join(before, [*by, "_part"]).select(*by, value, share.alias("_share"))
    return rows.join(ranks, [*by, value], "left").withColumn(name, normal_quantile(F.col("_share"))).select(*rows.columns, name)


def _rule(rule: str, rows: DataFrame, by: Sequence[str], most: int, fixed: int | None) -> DataFrame:
    if rule == "fd":
        return fd_counts(rows, "x", by)
    if rule == "knuth":
        return knuth_counts(rows, "x", by, most)
    if rule == "fixed" and fixed:
        return rows.groupBy(*by).agg(F.lit(fixed).alias("bins"))
    raise ValueError(f"no such rule: {rule}")


def point_estimates(
    members: DataFrame, obs: DataFrame, by: Sequence[str] = ("cell",), rule: str = "fd", alts: Sequence[float] = ALTS, s: str = "full", o_vs: str = "f",
    tiled: bool = True, loo_size: str = "pooled", most: int = KNUTH_MOST, fixed: int | None = None, bins: DataFrame | None = None, scores: bool = False,
) -> DataFrame:
    """(by, alt, b_f, b_o, b_s, b_p, i_o, i_m, lam_o, lam_m, lam) per cell and multiple of the bin counts.

    i_o pairs each member's value ("f") or the others' mean ("loo") with the observation, i_m the ensemble mean ("full") or the
    others' mean ("loo") with the member's value; members missing count as 0 (after scores). The rule sizes each axis on its values: f on
    all rows, o and a full mean on the rows (``tiled``) or on their times, the others' mean on all rows ("pooled") or on its mean at
    each time ("T"). ``bins(by, b_f, b_o, b_s, b_p)`` overrides the rule. Cells with an undefined count come out without values.
    """
    by = list(by)
    rows = with_means(members, by)
    if scores:
        o = normal_scores(obs, "o", by, "z").select(*by, "t", F.col("z").alias("o"))
        mean = normal_scores(rows.select(*by, "t", "s").distinct(), "s", by, "z_s").select(*by, "t", "z_s")
        rows = normal_scores(normal_scores(rows, "f", by, "z_f"), "loo", by, "z_loo").join(mean, [*by, "t"])
        rows = rows.select(*by, "member", "t", F.col("z_f").alias("f"), F.col("z_s").alias("s"), F.col("z_loo").alias("loo"))
        obs = o
    rows = rows.withColumns({"f": F.coalesce("f", F.lit(0.0)), "loo": F.coalesce("loo", F.lit(0.0))})
    rows = rows.join(obs.where("o IS NOT NULL"), [*by, "t"]).select(*by, "member", "t", "f", "s", "loo", "o")
    if bins is None:
        axis = lambda name, x, only=None: (only if only is not None else rows).select(*by, F.lit(name).alias("axis"), F.col(x).alias("x"))
        once = rows.groupBy(*by, "t").agg(F.first("o").alias("o"), F.first("s").alias("s"), F.avg("loo").alias("loo"))
        loo = axis("loo", "loo", once if loo_size == "T" else None)
        parts = [axis("f", "f"), axis("o", "o", None if tiled else once), axis("s", "s", None if tiled else once) if s == "full" else loo.withColumn("axis", F.lit("s"))]
        if o_vs == "loo":
            parts.append(loo.withColumn("axis", F.lit("p")))
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        sized = _rule(rule, every, [*by, "axis"], most, fixed)
        pick = lambda a: F.max(F.when(F.col("axis") == a, F.col("bins")))
        bins = sized.groupBy(*by).agg(*[pick(a).alias(f"b_{a}") for a in "fos"], (pick("p") if o_vs == "loo" else pick("f")).alias("b_p"))
    scaled = bins.withColumn("alt", F.explode(F.array(*map(F.lit, alts))))
    up = lambda c: F.ceil(F.col(c) * F.col("alt")).cast("int")
    x_o, x_m = ("loo" if o_vs == "loo" else "f"), ("loo" if s == "loo" else "s")
    pairs = rows.select(*by, F.explode(F.array(F.struct(F.lit("o").alias("of"), F.col("o").alias("x"), F.col(x_o).alias("y")), F.struct(F.lit("m").alias("of"), F.col(x_m).alias("x"), F.col("f").alias("y")))).alias("p")).select(*by, "p.*")
    counts = scaled.select(*by, "alt", F.explode(F.array(
        F.struct(F.lit("o").alias("of"), up("b_o").alias("bx"), up("b_p" if o_vs == "loo" else "b_f").alias("by_")),
        F.struct(F.lit("m").alias("of"), up("b_s").alias("bx"), up("b_f").alias("by_")),
    )).alias("p")).select(*by, "alt", "p.*")
    found = histogram_information(pairs, counts, [*by, "alt", "of"], [*by, "of"])
    value = lambda of: F.max(F.when(F.col("of") == of, F.col("mi")))
    wide = found.groupBy(*by, "alt").agg(value("o").alias("i_o"), value("m").alias("i_m"))
    defined = F.col("b_f").isNotNull() & F.col("b_o").isNotNull() & F.col("b_s").isNotNull() & F.col("b_p").isNotNull()
    out = scaled.join(wide, [*by, "alt"], "left").withColumns({c: F.when(defined, F.col(c)) for c in ("i_o", "i_m")})
    out = out.withColumns({"lam_o": lambda_bits(F.col("i_o")), "lam_m": lambda_bits(F.col("i_m"))})
    return out.withColumn("lam", F.when(F.col("lam_m") > 0, F.col("lam_o") / F.col("lam_m"))).select(*by, "alt", "b_f", "b_o", "b_s", "b_p", "i_o", "i_m", "lam_o", "lam_m", "lam")


def fixed_sweep(members: DataFrame, obs: DataFrame, counts: Sequence[int], by: Sequence[str] = ("cell",), **how: object) -> DataFrame:
    """``point_estimates`` at alt 1 with the same count on every axis, for each of ``counts``: one plan, keyed by b_f."""
    cells = members.select(*by).distinct().withColumn("b", F.explode(F.array(*map(F.lit, counts))))
    bins = cells.select(*by, *[F.col("b").alias(f"b_{a}") for a in "fosp"])
    keyed = lambda df: df.join(cells, list(by))
    out = point_estimates(keyed(members), keyed(obs), [*by, "b"], alts=(1.0,), bins=bins.withColumn("b", F.col("b_f")), **how)
    return out.drop("alt", "b_f", "b_o", "b_s", "b_p")


def entropy_ratios(members: DataFrame, obs: DataFrame, by: Sequence[str] = ("cell",), alts: Sequence[float] = ALTS) -> DataFrame:
    """(by, alt, i_gf, i_sf, h_f, h_g, gamma_o, gamma_m, gamma): the information that observation and mean have of the members, over entropies."""
    rows = with_means(members, by).withColumn("f", F.coalesce("f", F.lit(0.0))).join(obs, [*by, "t"])
    sized = {a: fd_counts(rows, a, by, f"b_{a}") for a in ("f", "o", "s")}
    bins = sized["f"].join(sized["o"], list(by)).join(sized["s"], list(by)).withColumn("alt", F.explode(F.array(*map(F.lit, alts))))
    up = lambda c: F.ceil(F.col(c) * F.col("alt")).cast("int")
    with_o = histogram_information(rows, bins.select(*by, "alt", up("b_o").alias("bx"), up("b_f").alias("by_")), [*by, "alt"], by, "o", "f")
    with_s = histogram_information(rows, bins.select(*by, "alt", up("b_s").alias("bx"), up("b_f").alias("by_")), [*by, "alt"], by, "s", "f")
    a = with_o.select(*by, "alt", F.col("mi").alias("i_gf"), F.col("h_y").alias("h_f"), F.col("h_x").alias("h_g"))
    out = a.join(with_s.select(*by, "alt", F.col("mi").alias("i_sf")), [*by, "alt"])
    out = out.withColumns({"gamma_o": F.try_divide("i_gf", "h_g"), "gamma_m": F.try_divide("i_sf", "h_f")})
    return out.withColumn("gamma", F.try_divide("gamma_o", "gamma_m"))


def band(points: DataFrame, by: Sequence[str] = ("cell",), floor: float = 0.02) -> DataFrame:
    """(by, i_o1, i_m1, lam1, d_i_o, d_i_m, d_lam, low, high): values at alt 1 and the width of the band over the alts."""
    lam = F.when(F.col("lam_m") > floor, F.col("lam_o") / F.col("lam_m"))
    rows = points.withColumns({"lam": lam, "off": F.abs(F.col("alt") - 1)})
    at = lambda c: F.min_by(c, "off")
    width = lambda c: F.max(c) - F.min(c)
    return rows.groupBy(*by).agg(
        at("i_o").alias("i_o1"), at("i_m").alias("i_m1"), at("lam").alias("lam1"), width("i_o").alias("d_i_o"), width("i_m").alias("d_i_m"), width("lam").alias("d_lam"),
        F.min("lam").alias("low"), F.max("lam").alias("high"),
    )


def total_correlation(members: DataFrame, bins: int, by: Sequence[str] = ("cell",)) -> DataFrame:
    """(by, tc): the sum over members of the information between each and all before it, pooled, in fixed bins."""
    first = members.select(*by, "t", F.col("member").alias("later"), F.col("f").alias("x"))
    pairs = first.join(members.select(*by, "t", "member", F.col("f").alias("y")), [*by, "t"]).where("member < later")
    sizes = pairs.select(*by, "later").distinct().select(*by, "later", F.lit(bins).alias("bx"), F.lit(bins).alias("by_"))
    return histogram_information(pairs, sizes, [*by, "later"], [*by, "later"]).groupBy(*by).agg(F.sum("mi").alias("tc"))


def _between(low: pd.Series, high: pd.Series, share: pd.Series) -> pd.Series:
    """The value at a share of the way, rounded as a fused multiply-add rounds it."""
    return pd.Series([math.fma(a, 1 - d, b * d) for a, b, d in zip(low, high, share)])


def fused_quantiles(rows: DataFrame, value: str, shares: Sequence[float], by: Sequence[str]) -> DataFrame:
    """(by, p): linear quantiles that equal another engine's to the last bit, for bounds that values of the data may lie on.

    ``percentile`` interpolates with two roundings, other engines with one. Distinct values are counted first, and their counts summed in order.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by)
    counts = counts.select(*by, "_v", F.sum("_c").over(w.orderBy("_v")).alias("_upto"), F.sum("_c").over(w).alias("_n"))
    places = [(F.col("_n") - 1) * F.lit(float(share)) for share in shares]
    reached = lambda place: F.min(F.when(F.col("_upto") > place, F.col("_v")))
    ends = [c for i, at in enumerate(places) for c in (reached(F.floor(at)).alias(f"_l{i}"), reached(F.ceil(at)).alias(f"_h{i}"), F.max(at - F.floor(at)).alias(f"_d{i}"))]
    between = F.pandas_udf(_between, "double")  # of a row per group
    return counts.groupBy(*by).agg(*ends).select(*by, F.array(*[between(f"_l{i}", f"_h{i}", f"_d{i}") for i in range(len(places))]).alias("p"))


def density(rows: DataFrame, value: str, bins: int, by: Sequence[str], tail: float = 0.00001) -> DataFrame:
    """(by, bin, centre, density): histogram between symmetric edges from the outer percentiles, values outside left out.

    With an even number of bins 0 lies on an edge, and the last bit of the outer ones decides which side it falls to.
    """
    ends = fused_quantiles(rows, value, (tail, 1 - tail), by)
    ends = ends.select(*by, F.greatest(F.abs(F.col("p")[0]), F.abs(F.col("p")[1])).alias("edge"))
    inside = rows.join(ends, list(by)).where(F.abs(F.col(value)) <= F.col("edge"))
    coded = inside.withColumn("bin", bin_of(F.col(value), -F.col("edge"), F.col("edge"), F.lit(bins)))
    counts = coded.groupBy(*by, "edge", "bin").agg(F.count("*").alias("c"))
    n, width = F.sum("c").over(Window.partitionBy(*by)), 2 * F.col("edge") / bins
    return counts.select(*by, "bin", (-F.col("edge") + (F.col("bin") + 0.5) * width).alias("centre"), (F.col("c") / (n * width)).alias("density"))


