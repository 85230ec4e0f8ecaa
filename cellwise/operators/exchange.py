"""Are members exchangeable? Pooled against per-member information, and its null by permuted member labels."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellwise.functions.scalar import wilson
from cellwise.operators import series as series_
from cellwise.operators.information import entropies, normal_scores
from cellwise.operators.pairs import with_means

TWO_SIDED, UPPER = ("delta", "i_pool_minus_cond"), ("i_mxy",)
STATS = ("i_cond", "i_pool_t", "delta", "i_pool", "i_pool_minus_cond", "i_mxy")


def code_of(value: Column, edges: Column) -> Column:
    """How many edges the value reaches: an edge belongs to the bin above it."""
    return F.size(F.filter(edges, lambda e: e <= value))


def quantile_codes(rows: DataFrame, value: str, bins: int, by: Sequence[str], name: str) -> DataFrame:
    """Add the equiprobable bin of ``value`` among all rows of its group (linear quantiles)."""
    edges = rows.groupBy(*by).agg(F.percentile(value, F.array(*[F.lit(k / bins) for k in range(1, bins)])).alias("_edges"))
    return rows.join(edges, list(by)).withColumn(name, code_of(F.col(value), F.col("_edges"))).drop("_edges")


def label_permutations(spark: SparkSession, reps: int, times: int, members: Sequence[int], block: int = 1, seed: int = 0) -> DataFrame:
    """(rep, t, member, source): for each rep and block of times an order of the members, by the MD5 of all of these, which any engine can repeat.

    The same for every cell, as field significance needs. The table has reps x times x members rows, whatever the number of cells.
    """
    blocks = -(-times // block)
    grid = spark.range(reps * blocks).select((F.floor(F.col("id") / blocks) + 1).cast("int").alias("rep"), (F.col("id") % blocks).cast("int").alias("b"))
    labels = grid.withColumn("members", F.array(*map(F.lit, members)))
    shuffled = F.array_sort(F.transform("members", lambda m: F.struct(F.md5(F.concat_ws(":", F.lit(seed), "rep", "b", m)).alias("h"), m.alias("m"))))
    pairs = labels.select("rep", "b", F.explode(F.arrays_zip(F.col("members").alias("member"), F.transform(shuffled, lambda s: s["m"]).alias("source"))).alias("p"))
    steps = F.sequence(F.col("b") * block, F.least(F.col("b") * block + block, F.lit(times)) - 1)
    return pairs.select("rep", F.explode(steps).alias("t"), "p.member", "p.source")


def rotations(spark: SparkSession, reps: int, times: int, members: Sequence[int], block: int = 1) -> DataFrame:
    """As ``label_permutations``, but turned by rep x (block + 1) places: a null that any engine can repeat."""
    n = len(members)
    grid = spark.range(reps * times * n).select((F.floor(F.col("id") / (times * n)) + 1).cast("int").alias("rep"), (F.floor(F.col("id") / n) % times).cast("int").alias("t"), (F.col("id") % n).cast("int").alias("k"))
    labels = F.array(*map(F.lit, members))
    turned = F.pmod(F.col("k") + F.col("rep") * (F.floor(F.col("t") / block) + 1), F.lit(n)).cast("int")
    return grid.select("rep", "t", F.get(labels, F.col("k")).alias("member"), F.get(labels, turned).alias("source"))


def time_permutations(spark: SparkSession, reps: int, times: int, block: int = 1, seed: int = 0) -> DataFrame:
    """(rep, t, source_t): for each rep the blocks of times in another order, by MD5; rep 0 as it is. The table has (reps + 1) x times rows."""
    blocks = -(-times // block)
    grid = spark.range((reps + 1) * blocks).select(F.floor(F.col("id") / blocks).cast("int").alias("rep"), (F.col("id") % blocks).cast("int").alias("b"))
    key = F.when(F.col("rep") == 0, F.lpad(F.col("b").cast("string"), 12, "0")).otherwise(F.md5(F.concat_ws(":", F.lit(seed), "rep", "b")))
    order = grid.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct(key.alias("key"), "b"))).alias("order"))
    step = lambda o: F.sequence(o["b"] * block, F.least(o["b"] * block + block, F.lit(times)) - 1)
    return order.select("rep", F.posexplode(F.flatten(F.transform("order", step))).alias("t", "source_t"))


class Rotations:
    """``rotations`` as a rule that a task carries out: no table of permutations grows with the times."""

    def __init__(self, reps: int, times: int, members: Sequence[int], block: int = 1):
        self.reps, self.times, self.members, self.block = np.arange(1, reps + 1), np.arange(times), np.array(sorted(members)), block
        self.order = np.searchsorted(self.members, np.array(list(members)))  # places of the members as they are given

    def source(self, first: int, end: int) -> np.ndarray:
        """(rep, member, t): the place of the source among the members, of the reps at these places."""
        n = len(self.members)
        turn = self.reps[first:end, None] * (self.times // self.block + 1)
        out = np.empty((len(turn), n, len(self.times)), np.int32)
        out[:, self.order] = self.order[(np.arange(n)[:, None] + turn[:, None]) % n]
        return out


class LabelPermutations(Rotations):
    """``label_permutations`` likewise; a task keeps the orders of the blocks, one byte or two a member, block and rep."""

    def __init__(self, reps: int, times: int, members: Sequence[int], block: int = 1, seed: int = 0):
        super().__init__(reps, times, members, block)
        self.seed, self.given, self.kept = seed, list(members), None

    def source(self, first: int, end: int) -> np.ndarray:
        if self.kept is None:
            n, blocks = len(self.given), -(-len(self.times) // self.block)
            self.kept = np.empty((len(self.reps), n, blocks), np.min_scalar_type(n))
            for r, rep in enumerate(self.reps.tolist()):
                for b in range(blocks):
                    hashes = [hashlib.md5(f"{self.seed}:{rep}:{b}:{m}".encode()).digest() for m in self.given]
                    self.kept[r, self.order, b] = self.order[sorted(range(n), key=hashes.__getitem__)]
        return self.kept[first:end][:, :, self.times // self.block].astype(np.int32)


class _Permutations:
    """Those of a table, as ``Rotations`` has them."""

    def __init__(self, permutations: DataFrame, most: int):
        self.reps, self.times, self.members, self.table = _table_of(permutations, most)

    def source(self, first: int, end: int) -> np.ndarray:
        return self.table[first:end]


def _table_of(permutations: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(reps, times, members, source): sorted values, and by their places the place of the source among the members."""
    n = permutations.count()
    if n > most:
        raise ValueError(f"{n} rows of permutations, more than {most}: test fewer at once")
    rows = permutations.select("rep", "t", "member", "source").toPandas()  # reps x times x members, whatever the number of cells
    reps, r = np.unique(rows["rep"], return_inverse=True)
    times, t = np.unique(rows["t"], return_inverse=True)
    members, m = np.unique(rows["member"], return_inverse=True)
    source = np.full((len(reps), len(members), len(times)), -1, np.int32)
    source[r, m, t] = np.searchsorted(members, rows["source"])
    return reps, times, members, source


def _detrended(x: np.ndarray) -> np.ndarray:
    """Rows less their lines over the places where they are known."""
    known = ~np.isnan(x)
    t = np.where(known, np.arange(x.shape[-1], dtype=float), np.nan)
    with np.errstate(invalid="ignore", divide="ignore"):
        t = t - np.nansum(t, -1, keepdims=True) / known.sum(-1, keepdims=True)
        y = x - np.nansum(x, -1, keepdims=True) / known.sum(-1, keepdims=True)
        return y - t * (np.nansum(t * y, -1, keepdims=True) / np.nansum(t * t, -1, keepdims=True))


def _entropies(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mi, h_xy) in bits of tables in the last two axes."""
    def h(c: np.ndarray, n: np.ndarray) -> np.ndarray:
        c = c.reshape(*n.shape, -1)
        return np.log2(n) - (c * np.log2(np.maximum(c, 1))).sum(-1) / n

    n = counts.sum((-1, -2))
    with np.errstate(invalid="ignore", divide="ignore"):
        both = h(counts, n)
        return h(counts.sum(-1), n) + h(counts.sum(-2), n) - both, both


def _gaussian(x: np.ndarray, y: np.ndarray, axes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(mi, h_xy) in bits of normal pairs with the moments that ``x`` and ``y`` have along ``axes``; pairs with a NaN don't count, no spread gives NaN."""
    both = ~(np.isnan(x) | np.isnan(y))
    n = both.sum(axes)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = lambda v: np.where(both, v, 0).sum(axes) / n
        a, b, c = mean(x * x) - mean(x) ** 2, mean(y * y) - mean(y) ** 2, mean(x * y) - mean(x) * mean(y)
        mi = -0.5 * np.log2(1 - np.minimum(c * c / (a * b), 1 - 1e-12))
        return mi, np.log2(2 * np.pi * np.e) + 0.5 * np.log2(np.maximum(a * b - c * c, 1e-300))


def _copula_of(zx: np.ndarray, zy: np.ndarray, picks: np.ndarray | None) -> dict[str, np.ndarray]:
    """As ``_statistics_of``, of normal scores (rep, member, t) by a Gaussian copula."""
    average = lambda v: np.where(np.isnan(v), 0, v).sum(1) / (~np.isnan(v)).sum(1)
    mi, own = (average(v) for v in _gaussian(zx, zy, (2,)))
    pooled, h_pool = _gaussian(zx, zy, (1, 2))
    out = {"i_cond": mi, "i_pool": pooled, "i_pool_minus_cond": pooled - mi, "i_mxy": h_pool - own}
    if picks is not None:
        when = np.arange(zx.shape[2])
        out["i_pool_t"] = average(_gaussian(zx[:, picks, when], zy[:, picks, when], (2,))[0])
        out["delta"] = out["i_pool_t"] - mi
    return out


def _scores(x: np.ndarray) -> np.ndarray:
    """Normal scores among all known values."""
    known, out = ~np.isnan(x), np.full(x.shape, np.nan)
    out[known] = series_.normal_scores(x[known], np.ones(known.sum()))
    return out


def _statistics_of(codes: np.ndarray, bins: int, picks: np.ndarray | None) -> dict[str, np.ndarray]:
    """Statistics of codes (rep, member, t), -1 where there is none; picks (k, t) are places of members."""
    reps, members, _ = codes.shape
    place = (np.arange(reps * members, dtype=np.int64) * bins * bins).reshape(reps, members, 1) + codes
    counts = np.bincount(place[codes >= 0], minlength=reps * members * bins * bins).reshape(reps, members, bins, bins).astype(float)
    there = counts.sum((-1, -2)) > 0
    mi, own = (np.where(there, x, 0).sum(1) / there.sum(1) for x in _entropies(counts))
    pooled, h_pool = _entropies(counts.sum(1))
    out = {"i_cond": mi, "i_pool": pooled, "i_pool_minus_cond": pooled - mi, "i_mxy": h_pool - own}
    if picks is not None:
        drawn = codes[:, picks, np.arange(codes.shape[2])]
        place = (np.arange(reps * len(picks), dtype=np.int64) * bins * bins).reshape(reps, len(picks), 1) + drawn
        sized = np.bincount(place[drawn >= 0], minlength=reps * len(picks) * bins * bins).reshape(reps, len(picks), bins, bins).astype(float)
        out["i_pool_t"] = _entropies(sized)[0].mean(1)
        out["delta"] = out["i_pool_t"] - mi
    return out


def pairs_of(members: DataFrame, bins: int, by: Sequence[str] = ("cell",)) -> DataFrame:
    """(by, member, t, cx, cy): codes of the others' mean and of the member, over all members and times of a cell."""
    rows = with_means(members, by)
    coded = quantile_codes(quantile_codes(rows, "loo", bins, by, "cx"), "f", bins, by, "cy")
    return coded.select(*by, "member", "t", "cx", "cy")


def statistics(pairs: DataFrame, by: Sequence[str], picks: DataFrame | None = None) -> DataFrame:
    """(by, i_cond, i_pool, i_mxy, i_pool_minus_cond[, i_pool_t, delta]) from codes.

    Rows become counts per member once; pooled tables are sums of those. ``picks(k, t, member)`` are pooled samples as long as one
    member's series.
    """
    counts = pairs.groupBy(*by, "member", "cx", "cy").agg(F.count("*").alias("c"))
    own = _weighted_entropies(counts, [*by, "member"]).groupBy(*by).agg(F.avg("mi").alias("i_cond"), F.avg("h_xy").alias("h_member"))
    pool = _weighted_entropies(counts, by).select(*by, F.col("mi").alias("i_pool"), F.col("h_xy").alias("h_pool"))
    out = own.join(pool, list(by)).withColumns({"i_mxy": F.col("h_pool") - F.col("h_member"), "i_pool_minus_cond": F.col("i_pool") - F.col("i_cond")})
    if picks is not None:
        drawn = pairs.join(picks, ["t", "member"])
        sized = entropies(drawn, [*by, "k"]).groupBy(*by).agg(F.avg("mi").alias("i_pool_t"))
        out = out.join(sized, list(by)).withColumn("delta", F.col("i_pool_t") - F.col("i_cond"))
    return out.select(*by, *[c for c in STATS if c in out.columns])


def _weighted_entropies(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, h_xy, mi) of counts (by, ..., cx, cy, c)."""
    joint = counts.groupBy(*by, "cx", "cy").agg(F.sum("c").alias("c"))
    keys = [F.col(k) for k in (*by, "cx", "cy")]
    sets = [[*map(F.col, by), *margin] for margin in ([F.col("cx"), F.col("cy")], [F.col("cx")], [F.col("cy")])]
    cubed = joint.groupingSets(sets, *keys).agg(F.sum("c").alias("c"), (F.grouping("cx") + 2 * F.grouping("cy")).alias("margin"))
    term = lambda margin: F.sum(F.when(F.col("margin") == margin, F.col("c") * F.log2("c")))
    sums = cubed.groupBy(*by).agg(F.sum(F.when(F.col("margin") == 0, F.col("c"))).alias("n"), term(0).alias("xy"), term(2).alias("x"), term(1).alias("y"))
    n = F.col("n")
    return sums.select(*by, (F.log2(n) - F.col("xy") / n).alias("h_xy"), (F.log2(n) - (F.col("x") + F.col("y") - F.col("xy")) / n).alias("mi"))


def copula_statistics(members: DataFrame, by: Sequence[str] = ("cell",)) -> DataFrame:
    """(by, i_cond, i_pool, i_mxy, i_pool_minus_cond) of a Gaussian copula: on normal scores over all members and times."""
    rows = normal_scores(normal_scores(with_means(members, by), "loo", by, "zx"), "f", by, "zy")

    def gauss(df: DataFrame, keys: Sequence[str]) -> DataFrame:
        v = df.groupBy(*keys).agg(F.var_pop("zx").alias("a"), F.var_pop("zy").alias("b"), F.covar_pop("zx", "zy").alias("c"))
        square = F.try_divide(F.col("c") * F.col("c"), F.col("a") * F.col("b"))
        det = F.greatest(F.col("a") * F.col("b") - F.col("c") * F.col("c"), F.lit(1e-300))
        return v.select(*keys, (-0.5 * F.log2(1 - F.least(square, F.lit(1 - 1e-12)))).alias("mi"), (F.log2(F.lit(2) * F.pi() * F.e()) + 0.5 * F.log2(det)).alias("h"))

    own = gauss(rows, [*by, "member"]).groupBy(*by).agg(F.avg("mi").alias("i_cond"), F.avg("h").alias("h_member"))
    out = own.join(gauss(rows, by).withColumnRenamed("mi", "i_pool").withColumnRenamed("h", "h_pool"), list(by))
    return out.select(*by, "i_cond", "i_pool", (F.col("h_pool") - F.col("h_member")).alias("i_mxy"), (F.col("i_pool") - F.col("i_cond")).alias("i_pool_minus_cond"))


def test_statistics(
    members: DataFrame, permutations: DataFrame | Rotations, bins: int, by: Sequence[str] = ("cell",), picks: DataFrame | Callable | None = None, detrended: bool = False, most: int = 20_000_000, at_once: int = 2_000_000, estimator: str = "bins",
) -> DataFrame:
    """(by, rep, statistics): rep 0 as observed, the others under permuted labels; edges stay those of the observed pairs.

    With ``detrended`` members are raw: each one's line is removed from the observed series, and from each permuted series anew; values that reach an edge but for
    rounding are in the bin above it, so a permutation that moves nothing gives what was observed. The permutations
    are the same for every cell: a rule, which each task carries out, or a table of at most ``most`` rows, which goes to every task; ``picks`` likewise, a table or a
    function of the times that gives members (k, t); a cell's members come together once, and all is done
    there, ``at_once`` pairs at a time, so that neither pairs nor counts of reps are ever shuffled. Missing values make no pairs. The ``estimator`` is "bins", or
    "copula": a Gaussian one on normal scores, whose ranks are those of the observed pairs and move with them (not with ``detrended``).
    """
    by = list(by)
    if estimator not in ("bins", "copula") or estimator == "copula" and detrended:
        raise ValueError("the estimator is bins, or copula without detrending")
    moves = permutations if isinstance(permutations, Rotations) else _Permutations(permutations, most)
    reps, times, labels = moves.reps, moves.times, moves.members
    pick = picks if callable(picks) else None
    if callable(picks):
        listed = None
    elif picks is not None:
        rows = picks.toPandas()
        ks, k = np.unique(rows["k"], return_inverse=True)
        listed = np.full((len(ks), len(times)), 0)
        listed[k, np.searchsorted(times, rows["t"])] = np.searchsorted(labels, rows["member"])
    else:
        listed = None
    names = [c for c in STATS if picks is not None or c not in ("i_pool_t", "delta")]

    def tested(frame: pd.DataFrame) -> pd.DataFrame:
        chosen = listed if pick is None else np.searchsorted(labels, pick(times))
        f = np.full((len(labels), len(times)), np.nan)
        f[np.searchsorted(labels, frame["member"]), np.searchsorted(times, frame["t"])] = frame["f"].to_numpy(float)
        raw, flat = (f, _others_mean(f)), (_detrended(f) if detrended else f)
        series = [flat, _others_mean(flat)]
        when = np.arange(len(times))
        if estimator == "copula":
            zy, zx = (_scores(v) for v in series)
            parts, step = [_copula_of(zx[None], zy[None], chosen)], max(1, at_once // max(zx.size, 1))
            for at in range(0, len(reps), step):
                of = moves.source(at, at + step)
                parts.append(_copula_of(*(np.where(of >= 0, v[of, when], np.nan) for v in (zx, zy)), chosen))
            return labelled(frame, parts)
        edges = [np.quantile(x[~np.isnan(x)], np.arange(1, bins) / bins) for x in series]
        if detrended:  # an edge may be a value of the data, which a line removed in another way gives but for rounding
            edges = [e - 1e-12 * np.nanmax(np.abs(x)) for e, x in zip(edges, series)]

        def coded(y: np.ndarray, x: np.ndarray) -> np.ndarray:
            cy, cx = (np.searchsorted(e, v.ravel(), "right").reshape(v.shape) for e, v in zip(edges, (y, x)))
            return np.where(np.isnan(x) | np.isnan(y), -1, cx * bins + cy)

        codes = coded(*series)
        parts, step = [_statistics_of(codes[None], bins, chosen)], max(1, at_once // max(codes.size, 1))
        for at in range(0, len(reps), step):
            of = moves.source(at, at + step)
            moved = coded(*(_detrended(v[of, when]) for v in raw)) if detrended else codes[of, when]
            parts.append(_statistics_of(np.where(of >= 0, moved, -1), bins, chosen))
        return labelled(frame, parts)

    def labelled(frame: pd.DataFrame, parts: list[dict[str, np.ndarray]]) -> pd.DataFrame:
        out = pd.DataFrame({c: np.concatenate([p[c] for p in parts]) for c in names})
        out.insert(0, "rep", np.concatenate([[0], reps]))
        for i, c in enumerate(by):
            out.insert(i, c, frame[c].iloc[0])
        return out

    rows = members.select(*by, "member", "t", F.col("f").cast("double").alias("f"))
    schema = ", ".join([*[f"{c} {rows.schema[c].dataType.simpleString()}" for c in by], "rep int", *[f"{c} double" for c in names]])
    return rows.where("f IS NOT NULL").groupBy(*by).applyInPandas(tested, schema)


def _others_mean(f: np.ndarray) -> np.ndarray:
    """At each time the mean of the other members, missing ones skipped; of members that are there alone, as rows have it."""
    there = ~np.isnan(f)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(there, (np.nansum(f, 0) - np.where(there, f, 0)) / (there.sum(0) - there), np.nan)


def significance(tested: DataFrame, by: Sequence[str] = ("cell",), two_sided: Sequence[str] = TWO_SIDED, upper: Sequence[str] = UPPER) -> DataFrame:
    """(by, stat, obs, null_mean, null_sd, corrected, p) from statistics by rep (0 the observed): one row per statistic.

    Two-sided about the null's mean, or the share of nulls at least as large; the observed one counts among them.
    """
    names = [c for c in tested.columns if c not in (*by, "rep")]
    long = tested.select(*by, "rep", F.explode(F.array(*[F.struct(F.lit(c).alias("stat"), F.col(c).alias("x")) for c in names])).alias("s")).select(*by, "rep", "s.*")
    null, keys = F.when(F.col("rep") > 0, F.col("x")), [*by, "stat"]
    sums = long.groupBy(*keys).agg(F.max(F.when(F.col("rep") == 0, F.col("x"))).alias("obs"), F.avg(null).alias("null_mean"), F.stddev_samp(null).alias("null_sd"), F.count(null).alias("n"), F.collect_list(null).alias("nulls"))  # of a group as many as reps
    # a hair's breadth so that sums in another order don't undo an equality
    far = F.size(F.filter("nulls", lambda x: F.abs(x - F.col("null_mean")) >= F.abs(F.col("obs") - F.col("null_mean")) - 1e-12))
    above = F.size(F.filter("nulls", lambda x: x >= F.col("obs") - 1e-12))
    out, hits = sums, F.when(F.col("stat").isin(*two_sided), far).when(F.col("stat").isin(*upper), above)
    return out.select(*keys, "obs", "null_mean", "null_sd", (F.col("obs") - F.col("null_mean")).alias("corrected"), ((1 + hits) / (F.col("n") + 1)).alias("p"))


def rejection_shares(tests: DataFrame, by: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """(by, stat, n, rejected, low, high, corrected): how often ``significance``'s tests reject, with Wilson's interval, and the mean excess over the null."""
    counts = tests.where("p IS NOT NULL").groupBy(*by, "stat").agg(F.count("*").alias("n"), F.count_if(F.col("p") <= alpha).alias("k"), F.avg("corrected").alias("corrected"))
    k, n = F.col("k").cast("double"), F.col("n").cast("double")
    return counts.withColumn("w", wilson(k, n)).select(*by, "stat", "n", (k / n).alias("rejected"), "w.low", "w.high", "corrected")


def field_significance(tested: DataFrame, grid: DataFrame, stat: str, alpha: float = 0.05) -> DataFrame:
    """One row (area_obs, null_area_mean, null_area_95, null_area_max, p_field): is the significant area larger than by chance?

    ``grid(cell, w)``. Each permutation's map is tested against the others as the observed one against all; their areas are the null.
    """
    rows = tested.select("cell", "rep", F.col(stat).alias("x")).where("x IS NOT NULL")
    cell = Window.partitionBy("cell")
    mean = F.avg(F.when(F.col("rep") > 0, F.col("x"))).over(cell)
    value = F.abs(F.col("x") - mean) if stat in TWO_SIDED else F.col("x")
    rows = rows.withColumn("v", F.round(value, 12)).withColumn("n", F.count_if(F.col("rep") > 0).over(cell))
    # ranks from the top count the values at least as large: equal ones get the last of their places
    at_least = F.count_if(F.col("rep") > 0).over(cell.orderBy(F.desc("v")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    p = F.when(F.col("rep") == 0, (1 + at_least) / (F.col("n") + 1)).otherwise(at_least / F.col("n"))
    areas = rows.withColumn("p", p).join(grid, "cell").groupBy("rep").agg((F.sum(F.when(F.col("p") <= alpha, F.col("w")).otherwise(0.0)) / F.sum("w")).alias("area"))
    observed = areas.where("rep = 0").select(F.col("area").alias("area_obs"))
    null = areas.where("rep > 0").crossJoin(F.broadcast(observed))  # one row
    return null.groupBy("area_obs").agg(
        F.avg("area").alias("null_area_mean"), F.percentile("area", F.lit(0.95)).alias("null_area_95"), F.max("area").alias("null_area_max"),
        ((1 + F.count_if(F.col("area") >= F.col("area_obs") - 1e-12)) / (1 + F.count("*"))).alias("p_field"),
    )


def time_rotations(spark: SparkSession, reps: int, times: int, block: int = 1) -> DataFrame:
    """(rep, t, source_t): times turned by rep blocks; rep 0 as it is."""
    blocks = -(-times // block)
    grid = spark.range((reps + 1) * times).select(F.floor(F.col("id") / times).cast("int").alias("rep"), (F.col("id") % times).cast("int").alias("t"))
    return grid.withColumn("source_t", (F.pmod(F.floor(F.col("t") / block) + F.col("rep"), F.lit(blocks)) * block + F.col("t") % block).cast("int")).where(F.col("source_t") < times)


def obs_information(members: DataFrame, obs: DataFrame, times: DataFrame, bins: int, by: Sequence[str] = ("cell",)) -> DataFrame:
    """(by, stat, obs, null_mean, null_sd, corrected, p) of i_o: the mean over members of the information of the others' mean about
    the observed series, never tiled; its null moves the observations in time by ``times(rep, t, source_t)``."""
    x = quantile_codes(with_means(members, by), "loo", bins, by, "cx").select(*by, "member", "t", "cx")
    g = quantile_codes(obs, "o", bins, by, "cy").select(*by, F.col("t").alias("source_t"), "cy")
    moved = g.join(times, "source_t").select(*by, "rep", "t", "cy")
    joined = x.join(moved, [*by, "t"])
    tested = entropies(joined, [*by, "rep", "member"]).groupBy(*by, "rep").agg(F.avg("mi").alias("i_o"))
    return significance(tested, by, (), ("i_o",))


def member_terms(pairs: DataFrame, by: Sequence[str] = ("cell",)) -> DataFrame:
    """(by, member, term): the pooled joint entropy less the member's own; their mean is i_mxy."""
    counts = pairs.groupBy(*by, "member", "cx", "cy").agg(F.count("*").alias("c"))
    own = _weighted_entropies(counts, [*by, "member"]).select(*by, "member", F.col("h_xy").alias("own"))
    pool = _weighted_entropies(counts, by).select(*by, F.col("h_xy").alias("pool"))
    return own.join(pool, list(by)).select(*by, "member", (F.col("pool") - F.col("own")).alias("term"))
