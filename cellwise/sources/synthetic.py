"""Ensembles with known answers, to test estimators on. Every value comes from the hash of its place, so any partition can make it again."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellwise.functions.scalar import lambda_bits
from cellwise.functions.special import normal_quantile
from cellwise.operators import battery, exchange, information, resample, rho
from cellwise.operators.pairs import ensemble_mean
from cellwise.sources.catalog import cut


def noise(*place: Column | str, seed: int) -> Column:
    """A standard normal value that depends on the place only."""
    share = (F.pmod(F.xxhash64(F.lit(seed), *place), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    return normal_quantile(share)


def _grid(spark: SparkSession, cells: int, members: int, times: int) -> DataFrame:
    ids = spark.range(cells * members * times)
    return ids.select(
        F.floor(F.col("id") / (members * times)).cast("int").alias("cell"), (F.floor(F.col("id") / times) % members).cast("int").alias("member"), (F.col("id") % times).cast("int").alias("t")
    )


def signal_and_noise(spark: SparkSession, cells: int, members: int, times: int, beta: float | Sequence[float], sigma: float | Sequence[float] = 1.0, sigma_obs: float = 1.0, shift: float | Sequence[float] = 0.0, seed: int = 0, phi: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """members: beta x signal + sigma x noise + shift; observations: signal + sigma_obs x noise. beta, sigma and shift may differ by member; its noise may be AR(1) by ``phi``."""
    each = lambda v: F.get(F.array(*[F.lit(float(x)) for x in v]), F.col("member")) if isinstance(v, Sequence) else F.lit(float(v))
    rows = _grid(spark, cells, members, times).withColumns({"s": noise("cell", "t", seed=seed), "e": noise("cell", "t", "member", seed=seed + 1)})
    if phi:
        rows = autoregressive(rows, phi, ["cell", "member"], "e")
    f = each(beta) * F.col("s") + each(sigma) * F.col("e") + each(shift)
    obs = _grid(spark, cells, 1, times).select("cell", "t", (noise("cell", "t", seed=seed) + sigma_obs * noise("cell", "t", seed=seed + 2)).alias("o"))
    return rows.select("cell", "member", "t", f.alias("f")), obs


def autoregressive(rows: DataFrame, phi: float, by: Sequence[str], value: str = "f", reach: int | None = None) -> DataFrame:
    """White noise ``value`` made into an AR(1) series of the same variance: a weighted sum of the last values (as far as weights matter)."""
    reach = reach or max(1, math.ceil(math.log(1e-9) / math.log(abs(phi)))) if phi else 1
    w = Window.partitionBy(*by).orderBy("t")
    before = F.collect_list(value).over(w.rowsBetween(-reach, 0))
    # the first value stands for all that came before it
    scale = math.sqrt(1 - phi * phi)
    sum_ = F.aggregate(before, F.struct(F.lit(0.0).alias("x"), F.lit(0).alias("k")), lambda a, v: F.struct((a["x"] * phi + v * F.when(a["k"] == 0, 1.0).otherwise(scale)).alias("x"), (a["k"] + 1).alias("k")))
    return rows.withColumn(value, sum_["x"])


def distorted(rows: DataFrame, value: str, a: float) -> DataFrame:
    """An increasing, skewing distortion: expm1(a x) / a."""
    return rows.withColumn(value, F.expm1(F.col(value) * a) / a) if a else rows


def exact_lambda(rho: float) -> float:
    """Of Gaussian variables lambda is the absolute correlation."""
    return abs(rho)


def rejection_rates(
    spark: SparkSession, draws: int, members: int, times: int, reps: int, bins: int, alpha: float = 0.05, seed: int = 0, phi: float = 0.0, block: int = 1, lognormal: bool = False, detrended: bool = False, **design: object
) -> DataFrame:
    """(stat, n, rejected, low, high, corrected): how often the exchangeability test rejects, over draws of a design (its cells), under shared permutations.

    Members' noise may be AR(1) by ``phi`` and their values exponentials; labels move in blocks of times, with the members' lines removed inside the test or not.
    """
    rows, _ = signal_and_noise(spark, draws, members, times, seed=seed, phi=phi, **design)
    if lognormal:
        rows = rows.withColumn("f", F.exp("f"))
    perms = exchange.label_permutations(spark, reps, times, list(range(members)), block, seed=seed)
    return exchange.rejection_shares(exchange.significance(exchange.test_statistics(rows, perms, bins, detrended=detrended)), alpha=alpha)


def rejection_grid(spark: SparkSession, designs: Mapping[str, Mapping[str, object]], draws: int, members: int, times: int, reps: int, bins: int, **how: object) -> DataFrame:
    """``rejection_rates`` of named designs, each a set of its arguments such as phi, block or beta, with the name as a column."""
    parts = [rejection_rates(spark, draws, members, times, reps, bins, **(dict(how) | dict(d))).withColumn("design", F.lit(name)) for name, d in designs.items()]
    return reduce(DataFrame.unionByName, parts)


def equicorrelated(spark: SparkSession, rs: Sequence[float], members: int, times: int, seed: int = 0) -> DataFrame:
    """(cell, r, member, t, f): for each r an array of unit variables of which any two correlate by r; a cell per r, the same noise in all."""
    rows = _grid(spark, len(rs), members, times).withColumn("r", F.get(F.array(*[F.lit(float(r)) for r in rs]), F.col("cell")))
    shared, own = noise("t", seed=seed), noise("t", "member", seed=seed + 1)
    return rows.select("cell", "r", "member", "t", (F.sqrt("r") * shared + F.sqrt(1 - F.col("r")) * own).alias("f"))


def equicorrelated_metrics(arrays: DataFrame) -> DataFrame:
    """(r, gamma_m, lambda_m, rho_1, rho_2) of ``equicorrelated``: information's share of the members' entropy and its lambda, both with Freedman-Diaconis bins, and both correlations."""
    f = arrays.select("cell", "member", "t", "f")
    s = ensemble_mean(f)
    ratios = information.entropy_ratios(f, s.select("cell", "t", F.col("s").alias("o")), alts=(1.0,)).select("cell", "gamma_m", lambda_bits(F.col("i_sf")).alias("lambda_m"))
    rho_1 = rho.variance_ratios(f).select("cell", F.col("by_variance").alias("rho_1"))
    rho_2 = rho.member_rho(f).groupBy("cell").agg(F.avg("rho").alias("rho_2"))
    return ratios.join(rho_1, "cell").join(rho_2, "cell").join(arrays.select("cell", "r").distinct(), "cell").select("r", "gamma_m", "lambda_m", "rho_1", "rho_2")


def shared_signal(spark: SparkSession, shares: Sequence[float], skills: Sequence[float], times: int, seed: int = 0, exponential: bool = False) -> tuple[DataFrame, DataFrame]:
    """members(cell, a, member, t, f) and obs(cell, t, o): a member's share of its variance is signal (``shares``, a value per member), as is the observations' (``skills``, a cell each).

    Signal and noises are the same in all cells. With ``exponential`` the observed signal is the standardised exponential of the members'.
    """
    n = len(shares)
    rows = _grid(spark, len(skills), n, times).withColumns({"a": F.get(F.array(*[F.lit(float(a)) for a in skills]), F.col("cell")), "share": F.get(F.array(*[F.lit(float(x)) for x in shares]), F.col("member"))})
    signal = noise("t", seed=seed)
    f = F.sqrt("share") * signal + F.sqrt(1 - F.col("share")) * noise("t", "member", seed=seed + 1)
    e = math.e
    seen = (F.exp(signal) - math.sqrt(e)) / math.sqrt(e * (e - 1)) if exponential else signal  # mean and spread of a lognormal
    obs = rows.where("member = 0").select("cell", "t", (F.sqrt("a") * seen + F.sqrt(1 - F.col("a")) * noise("t", seed=seed + 2)).alias("o"))
    return rows.select("cell", "a", "member", "t", f.alias("f")), obs


def gap_grid(spark: SparkSession, sizes: Sequence[tuple[int, int]], ratios: Sequence[float], draws: int, shifts: Sequence[int], most: int = information.KNUTH_MOST, seed: int = 0) -> DataFrame:
    """(members, times, rho, draw, ...): ``resample.lambda_m_variants`` of ensembles of some sizes (members, times) whose model correlation is each of ``ratios``; the observations are one more member."""
    parts = []
    for k, (n, times) in enumerate(sizes):
        rows = _grid(spark, len(ratios) * draws, n + 1, times)
        r = F.get(F.array(*[F.lit(correlation_for(x, n)) for x in ratios]), F.floor(F.col("cell") / draws).cast("int"))
        rows = rows.withColumn("f", F.sqrt(r) * noise("cell", "t", seed=seed + 3 * k) + F.sqrt(1 - r) * noise("cell", "t", "member", seed=seed + 3 * k + 1))
        obs = rows.where(F.col("member") == n).select("cell", "t", F.col("f").alias("o"))
        found = resample.lambda_m_variants(rows.where(F.col("member") < n), obs, shifts, times, most=most)
        rho_ = F.get(F.array(*[F.lit(float(x)) for x in ratios]), F.floor(F.col("cell") / draws).cast("int")).alias("rho")
        parts.append(found.select(F.lit(n).alias("members"), F.lit(times).alias("times"), rho_, (F.col("cell") % draws).alias("draw"), *found.columns[1:]))
    return reduce(DataFrame.unionByName, parts)


def equicorrelated_ratio(members: int, r: float) -> float:
    """The model's correlation of the others' mean with a member, if any two members correlate by r."""
    others = members - 1
    return r / math.sqrt((1 + (others - 1) * r) / others)


def correlation_for(ratio: float, members: int) -> float:
    """The correlation of any two members that gives ``equicorrelated_ratio`` of them."""
    others, q = members - 1, ratio * ratio
    # r^2 others = q (1 + (others - 1) r)
    return (q * (others - 1) + math.sqrt((q * (others - 1)) ** 2 + 4 * others * q)) / (2 * others)


def toys(spark: SparkSession, n: int, draws: int, seed: int = 0, sigma: float = 0.75) -> DataFrame:
    """(case, exact, draw, t, x, y): pairs whose lambda is known, ``draws`` of n each: independent, Gaussian, a skewing distortion of it, and a parabola with noise of ``sigma``.

    All cases share the noise of a draw, and a draw is a key: an estimator runs on all of them in one plan.
    """
    u = 0.8 * F.col("x") + 0.6 * F.col("z")
    cases = {"independent": (F.col("z"), 0.0), "gaussian": (u, 0.8), "skewed": (F.expm1(2.0 * u) / 2.0, 0.8), "non-monotonic": (F.col("x") * F.col("x") + sigma * F.col("z"), parabola_lambda(sigma))}
    rows = spark.range(draws * n).select(F.floor(F.col("id") / n).cast("int").alias("draw"), (F.col("id") % n).cast("int").alias("t"))
    rows = rows.withColumns({"x": noise("draw", "t", seed=seed), "z": noise("draw", "t", seed=seed + 1)})
    every = F.explode(F.array(*[F.struct(F.lit(k).alias("case"), F.lit(exact).alias("exact"), y.alias("y")) for k, (y, exact) in cases.items()]))
    return rows.select("draw", "t", "x", every.alias("c")).select("c.case", "c.exact", "draw", "t", "x", "c.y")


def mixture_entropy(centres: Sequence[float], weights: Sequence[float], sigma: float, steps: int = 20_000) -> float:
    """The entropy in nats of a mixture of normal densities of one width: the trapezoid rule over a table of nodes."""
    c, w = np.asarray(centres, float), np.asarray(weights, float) / np.sum(weights)
    y = np.linspace(c[w > 1e-16].min() - 9 * sigma, c[w > 1e-16].max() + 9 * sigma, steps)
    p = np.zeros(steps)
    for centre, weight in zip(c, w):
        p += weight * np.exp(-0.5 * ((y - centre) / sigma) ** 2) / (sigma * math.sqrt(2 * math.pi))
    return float(np.trapezoid(-np.where(p > 0, p * np.log(np.where(p > 0, p, 1)), 0), y))


def parabola_lambda(sigma: float = 0.75, nodes: int = 1600) -> float:
    """Of (x, x^2 + sigma z) with standard normal x and z: the information is the entropy of y less that of its noise; x enters by equal steps of its positive half."""
    x = (np.arange(nodes) + 0.5) * (8.0 / nodes)
    information_ = mixture_entropy(x * x, np.exp(-0.5 * x * x), sigma) - 0.5 * math.log(2 * math.pi * math.e * sigma * sigma)
    return math.sqrt(1 - math.exp(-2 * information_))


def siegert_ratio(share: float, members: int) -> float:
    """The mean's spread over a member's, if a ``share`` of a member's variance is common: the curve of the spread ratio against the ensemble's size."""
    return math.sqrt(share + (1 - share) / members)


def toy_study(spark: SparkSession, sizes: Sequence[int], draws: int, rotations: int = 20, seed: int = 0) -> DataFrame:
    """(case, n, estimator, exact, median, p5, p95, bias, rmse, share_zero) of the whole ``battery`` over draws of the ``toys`` at each of ``sizes``."""
    parts = []
    for n in sizes:
        pairs = cut(toys(spark, n, draws, seed))  # seven estimators read it
        found = battery.estimates(pairs.drop("exact"), ["case", "draw"], range(1, min(n, rotations + 1)))
        exact = pairs.select("case", "exact").distinct()
        parts.append(resample.summarise_estimates(found.join(F.broadcast(exact), "case"), "lam", "exact", ["case", "estimator", "exact"]).withColumn("n", F.lit(n)))  # a row per case
    return reduce(DataFrame.unionByName, parts)
