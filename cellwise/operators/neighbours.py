"""Mutual information from nearest neighbours (Kraskov, Stoegbauer and Grassberger's first estimator)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellwise.functions.scalar import lambda_nats
from cellwise.functions.special import digamma, digammas
from cellwise.operators import series
from cellwise.operators.information import normal_scores
from cellwise.operators.pairs import ensemble_mean, with_means

#: Series of more points are cut into blocks along each axis, by at most so many edges.
BLOCK, EDGES = 1_000_000, 1023


class Strips:
    """Points in strips of neighbouring x, each sorted by y, so that near points lie near each other in few strips."""

    def __init__(self, x: np.ndarray, y: np.ndarray, k: int, aim: int = 16):
        order = np.lexsort((y, x))
        count = max(1, min(int((k * len(x)) ** 0.5 / aim), len(x) // (4 * aim) or 1))
        self.k, self.window = k, 2 * aim
        self.rows = [part[np.argsort(y[part], kind="stable")] for part in np.array_split(order, count)]
        self.x, self.y = [x[r] for r in self.rows], [y[r] for r in self.rows]
        self.low, self.high = np.array([v.min() for v in self.x]), np.array([v.max() for v in self.x])

    def near(self, at: int, qx: np.ndarray, qy: np.ndarray, best: np.ndarray) -> np.ndarray:
        """``best`` (queries x distances, ascending) after the points of strip ``at``. A window in y widens until what lies outside is farther than the last."""
        x, y = self.x[at], self.y[at]
        best, todo, width = best.copy(), np.arange(len(qx)), self.window
        while len(todo):
            place = np.searchsorted(y, qy[todo])
            first = np.clip(place - width // 2, 0, max(len(y) - width, 0))
            index = first[:, None] + np.arange(min(width, len(y)))
            far = np.maximum(np.abs(x[index] - qx[todo, None]), np.abs(y[index] - qy[todo, None]))
            keep = best.shape[1]
            found = np.sort(np.partition(np.concatenate([best[todo], far], axis=1), keep - 1, axis=1)[:, :keep], axis=1)
            end = first + index.shape[1]
            below = np.where(first > 0, qy[todo] - y[np.maximum(first - 1, 0)], np.inf)
            above = np.where(end < len(y), y[np.minimum(end, len(y) - 1)] - qy[todo], np.inf)
            done = np.minimum(below, above) >= found[:, -1]
            best[todo[done]] = found[done]
            todo, width = todo[~done], 4 * width
        return best

    def outward(self, begin: np.ndarray, step: int, qx: np.ndarray, qy: np.ndarray, best: np.ndarray) -> np.ndarray:
        """``best`` after the strips from ``begin`` on to one side, as far as each query needs them."""
        at, todo = begin.copy(), np.arange(len(qx))
        while len(todo):
            inside = (at[todo] >= 0) & (at[todo] < len(self.rows))
            todo = todo[inside]
            gap = (qx[todo] - self.high[at[todo]]) if step < 0 else (self.low[at[todo]] - qx[todo])
            todo = todo[gap < best[todo, -1]]
            for strip in np.unique(at[todo]):
                of = todo[at[todo] == strip]
                best[of] = self.near(int(strip), qx[of], qy[of], best[of])
            at[todo] += step
        return best

    def own(self, n: int) -> np.ndarray:
        """Of each of the n points the k + 1 smallest distances, the first its own."""
        best, at = np.full((n, self.k + 1), np.inf), np.empty(n, np.int64)
        qx, qy = np.empty(n), np.empty(n)
        for strip, rows in enumerate(self.rows):
            at[rows], qx[rows], qy[rows] = strip, self.x[strip], self.y[strip]
            best[rows] = self.near(strip, qx[rows], qy[rows], best[rows])
        return self.outward(at + 1, 1, qx, qy, self.outward(at - 1, -1, qx, qy, best))

    def of(self, qx: np.ndarray, qy: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Of other points the k + 1 smallest distances that lie below ``reach``; infinite beyond."""
        best = np.repeat(reach[:, None], self.k + 1, axis=1)
        begin = np.minimum(np.searchsorted(self.high, qx), len(self.rows) - 1)
        best = self.outward(begin - 1, -1, qx, qy, self.outward(begin, 1, qx, qy, best))
        return np.where(best < reach[:, None], best, np.inf)


def nearer(values: np.ndarray, q: np.ndarray, reach: np.ndarray, side: int) -> np.ndarray:
    """Of sorted values how many lie within ``reach`` of q, strictly, or beyond it on the other side (below for side 1, above for -1)."""
    if side < 0:
        return nearer(-values[::-1], -q, reach, 1)
    at = np.searchsorted(values, q + reach)
    while len(short := np.flatnonzero((at < len(values)) & (values[np.minimum(at, len(values) - 1)] - q < reach))):  # the sum may round
        at[short] = np.searchsorted(values, values[at[short]], "right")
    while len(long := np.flatnonzero((at > 0) & (values[np.maximum(at - 1, 0)] - q >= reach))):
        at[long] = np.searchsorted(values, values[at[long] - 1])
    return at


def _counts(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each point how many others are strictly nearer in x, and in y, than its k-th neighbour by the larger of both distances."""
    reach = Strips(x, y, k).own(len(x))[:, k]
    within = lambda v: np.maximum(nearer(s := np.sort(v), v, reach, 1) + nearer(s, v, reach, -1) - len(v) - 1, 0)
    return within(x), within(y)


def neighbour_counts(pairs: DataFrame, by: Sequence[str], k: int = 4, block: int = BLOCK) -> DataFrame:
    """(by, nx, ny): of each point how many others are strictly nearer in x, and in y, than its k-th neighbour by the larger of both distances.

    Series of up to ``block`` points are done in one task each, longer ones in blocks along x: a point's k-th neighbour in its own block bounds how far others can
    matter, and it is sought in these other blocks alone. Their counts come from places in the blocks of each axis. Points without x or y are left out, series of no
    more than k points have no rows; ties count as the strict comparison has it. A heap of one value stays in one block.
    """
    by = list(by)
    points = pairs.select(*by, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    sizes = points.groupBy(*by).agg(F.count("*").alias("_n"))
    keys = ", ".join(f"{c} {dict(points.dtypes)[c]}" for c in by)
    sized = points.join(sizes.where(F.col("_n") > k), by)

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        nx, ny = _counts(frame["x"].to_numpy(), frame["y"].to_numpy(), k)
        return pd.DataFrame({**{c: frame[c] for c in by}, "nx": nx, "ny": ny})

    short = sized.where(F.col("_n") <= block).drop("_n").groupBy(*by).applyInPandas(count, f"{keys}, nx long, ny long")
    long = sized.where(F.col("_n") > block)
    return short.unionByName(_long_counts(long, by, keys, k, block))


def _long_counts(points: DataFrame, by: list[str], keys: str, k: int, block: int) -> DataFrame:
    shares = F.array(*[F.lit(i / (EDGES + 1)) for i in range(1, EDGES + 1)])
    every = F.ceil((EDGES + 1) / F.ceil(F.max("_n") / block))  # so many parts of the EDGES make a block
    edges = points.groupBy(*by).agg(*[F.percentile_approx(a, shares, F.lit(10 * EDGES)).alias(a) for a in "xy"], every.alias("_every"))
    some = lambda a: F.array_sort(F.array_distinct(F.filter(a, lambda _, i: (i + 1) % F.col("_every") == 0)))
    edges = edges.select(*by, some("x").alias("_ex"), some("y").alias("_ey"))  # a row per long series
    block_of = lambda value, axis: F.size(F.filter(axis, lambda e: e <= value))
    placed = points.drop("_n").join(edges, by).select(*by, "x", "y", block_of(F.col("x"), "_ex").alias("_bx"), block_of(F.col("y"), "_ey").alias("_by"))

    def bounded(frame: pd.DataFrame) -> pd.DataFrame:
        x, y = frame["x"].to_numpy(), frame["y"].to_numpy()
        out = frame.reset_index(drop=True)
        out["_id"] = np.lexsort((y, x)).argsort()
        out["_best"] = list(Strips(x, y, k).own(len(x)))
        return out

    schema = f"{keys}, x double, y double, _bx int, _by int, _id long, _best array<double>"
    first = placed.groupBy(*by, "_bx").applyInPandas(bounded, schema)
    reach = F.element_at("_best", -1)
    ranged = first.join(edges, by)
    others = F.filter(F.sequence(block_of(F.col("x") - reach, "_ex"), block_of(F.col("x") + reach, "_ex")), lambda b: b != F.col("_bx"))
    asked = ranged.select(*by, F.col("_bx").alias("_home"), "_id", "x", "y", reach.alias("_reach"), F.explode(others).alias("_bx"))

    def answered(queries: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        out = queries[[*by, "_home", "_id"]].reset_index(drop=True)
        if not len(out) or not len(there):
            return out[:0].assign(_more=[])
        out["_more"] = list(Strips(there["x"].to_numpy(), there["y"].to_numpy(), k).of(*(queries[c].to_numpy() for c in ("x", "y", "_reach"))))
        return out

    found = asked.groupBy(*by, "_bx").cogroup(placed.groupBy(*by, "_bx")).applyInPandas(answered, f"{keys}, _home int, _id long, _more array<double>")
    more = found.groupBy(*by, F.col("_home").alias("_bx"), "_id").agg(F.flatten(F.collect_list("_more")).alias("_more"))  # k + 1 a block asked
    nearest = F.slice(F.array_sort(F.concat("_best", F.coalesce("_more", F.array().cast("array<double>")))), 1, k + 1)
    exact = first.join(more, [*by, "_bx", "_id"], "left").select(*by, "_bx", "_id", "x", "y", F.element_at(nearest, k + 1).alias("_reach"))
    out = exact.select(*by, "_bx", "_id")
    for axis in "xy":
        counted = _within(exact, placed, edges, by, keys, axis, block_of)
        out = out.join(counted, [*by, "_bx", "_id"])
    return out.select(*by, "nx", "ny")


def _within(exact: DataFrame, placed: DataFrame, edges: DataFrame, by: list[str], keys: str, axis: str, block_of: Callable) -> DataFrame:
    """(by, _bx, _id, n<axis>): how many others lie within the point's reach along the axis, from its bounds' places in the axis' blocks."""
    parts, ends = f"_b{axis}", f"_e{axis}"
    totals = placed.groupBy(*by, parts).agg(F.count("*").alias("_c"))
    before = totals.select(*by, parts, (F.sum("_c").over(Window.partitionBy(*by).orderBy(parts)) - F.col("_c")).alias("_before"))  # a row per block
    sides = F.explode(F.array(F.lit(-1), F.lit(1))).alias("_side")
    bound = F.col(axis) + F.col("_side") * F.col("_reach")
    slack = 1e-14 * (F.abs(bound) + F.col("_reach"))  # rounding may part the bound from the comparison
    touched = F.sequence(block_of(bound - slack, ends), block_of(bound + slack, ends))
    asked = exact.select(*by, F.col("_bx").alias("_home"), "_id", F.col(axis).alias("q"), F.col(axis), "_reach", sides).join(edges, by)
    asked = asked.select(*by, "_home", "_id", "q", "_reach", "_side", touched.alias("_all")).select("*", F.explode("_all").alias(parts), F.element_at("_all", 1).alias("_first"))

    def placed_in(queries: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        values = np.sort(there[axis].to_numpy())
        out = queries[[*by, "_home", "_id", "_side", parts, "_first"]].reset_index(drop=True)
        q, reach, side = (queries[c].to_numpy() for c in ("q", "_reach", "_side"))
        out["_c"] = np.where(side > 0, nearer(values, q, reach, 1), len(values) - nearer(values, q, reach, -1)) if len(values) else 0
        return out

    schema = f"{keys}, _home int, _id long, _side int, {parts} int, _first int, _c long"
    local = asked.groupBy(*by, parts).cogroup(placed.groupBy(*by, parts)).applyInPandas(placed_in, schema)
    # the place of a bound: all in lower blocks, and those before it in the blocks that it touches
    local = local.join(before, [*by, parts], "left")
    place = F.col("_c") + F.when(F.col(parts) == F.col("_first"), F.coalesce("_before", F.lit(0))).otherwise(0)
    sums = local.groupBy(*by, F.col("_home").alias("_bx"), "_id").agg(F.sum(place * F.col("_side")).alias("_w"))
    return sums.select(*by, "_bx", "_id", F.greatest(F.col("_w") - 1, F.lit(0)).alias(f"n{axis}"))


def ksg_information(pairs: DataFrame, by: Sequence[str], k: int = 4) -> DataFrame:
    """(by, mi) in nats, of ``pairs(by, x, y)`` without ties; series of no more than k points have none."""
    counts = neighbour_counts(pairs, by, k)
    mean = F.avg(digamma(F.col("nx") + 1) + digamma(F.col("ny") + 1))
    return counts.groupBy(*by).agg((digamma(F.lit(k)) + digamma(F.count("*")) - mean).alias("mi"))


def ksg_lambda(members: DataFrame, obs: DataFrame, by: Sequence[str] = ("cell",), k: int = 4, most_members: int = 16, floor: float = 0.02, jitter: float = 1e-9) -> DataFrame:
    """(by, lam_o, lam_m, lam) on normal scores: ensemble mean and observation; member and others' mean, averaged over members.

    Of more than ``most_members`` members those with the least hash count. Ties are parted by a jitter from the hash of their place.
    """
    noise = lambda seed: (F.pmod(F.xxhash64(F.lit(seed), *by, "series", "t"), F.lit(1 << 20)) / (1 << 20) - 0.5) * jitter
    rows = with_means(members, by)
    least = F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64(F.lit(16), "member"), "member"))
    chosen = members.select(*by, "member").distinct().withColumn("place", least).where(F.col("place") <= most_members).drop("place")
    own = rows.join(chosen, [*by, "member"]).select(*by, F.col("member").alias("series"), "t", F.col("f").alias("a"), F.col("loo").alias("b"))
    mean = ensemble_mean(members, by).join(obs, [*by, "t"]).select(*by, F.lit(-1).alias("series"), "t", F.col("o").alias("a"), F.col("s").alias("b"))
    every = own.unionByName(mean).where("a IS NOT NULL AND b IS NOT NULL")
    keys = [*by, "series"]
    scored = normal_scores(normal_scores(every, "a", keys, "za"), "b", keys, "zb")
    found = ksg_information(scored.select(*keys, (F.col("za") + noise(1)).alias("x"), (F.col("zb") + noise(2)).alias("y")), keys, k)
    out = found.groupBy(*by).agg(F.avg(F.when(F.col("series") == -1, F.col("mi"))).alias("i_o"), F.avg(F.when(F.col("series") != -1, F.col("mi"))).alias("i_m"))
    return lambdas(out, by, floor)


def lambdas(found: DataFrame, by: Sequence[str], floor: float) -> DataFrame:
    out = found.select(*by, lambda_nats(F.col("i_o")).alias("lam_o"), lambda_nats(F.col("i_m")).alias("lam_m"))
    return out.withColumn("lam", F.when(F.col("lam_m") > floor, F.col("lam_o") / F.col("lam_m")))


def information_of(x: np.ndarray, y: np.ndarray, k: int) -> float | None:
    """``ksg_information`` of one series of known points; None for no more than k."""
    n = len(x)
    if n <= k:
        return None
    nx, ny = _counts(x, y, k)
    psi = digammas(np.arange(1, n + 1))
    return float(psi[k - 1] + psi[n - 1] - (psi[nx] + psi[ny]).mean())


def scored(values: np.ndarray, use: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Normal scores of the values in use, by their weights; NaN elsewhere."""
    out = np.full(values.shape, np.nan)
    if use.any():
        out[use] = series.normal_scores(values[use], weights[use])
    return out


def _scored_information(a: np.ndarray, b: np.ndarray, noise: np.ndarray, k: int) -> float | None:
    """``ksg_information`` of one series on normal scores, parted by ``noise`` (2 x points); None for no more than k points."""
    use = ~(np.isnan(a) | np.isnan(b))
    return information_of(*(series.normal_scores(v[use], np.ones(use.sum())) + e[use] for v, e in zip((a, b), noise)), k)


def ksg_cells(members: DataFrame, obs: DataFrame, by: Sequence[str] = ("cell",), k: int = 4, most_members: int = 16, floor: float = 0.02, jitter: float = 1e-9) -> DataFrame:
    """``ksg_lambda``, all in the task that holds a cell: for cells whose members x times values fit one."""
    by = list(by)
    kinds = dict(members.dtypes)
    label = "int" if kinds["member"] in ("tinyint", "smallint") else kinds["member"]
    own = members.select(*by, F.lit(False).alias("_obs"), F.col("member").cast(label).alias("series"), "t", F.col("f").cast("double").alias("v"))
    seen = obs.where("t IS NOT NULL").select(*by, F.lit(True).alias("_obs"), F.lit(-1).cast(label).alias("series"), F.col("t").cast(kinds["t"]).alias("t"), F.col("o").cast("double").alias("v"))
    share = lambda seed: ((F.pmod(F.xxhash64(F.lit(seed), *by, "series", "t"), F.lit(1 << 20)) / (1 << 20) - 0.5) * jitter).alias(f"_n{seed}")
    every = own.unionByName(seen).where(" AND ".join(f"{c} IS NOT NULL" for c in by))
    every = every.select(*by, "_obs", "series", "t", "v", share(1), share(2), F.xxhash64(F.lit(16), "series").alias("_order"))

    def found(frame: pd.DataFrame) -> pd.DataFrame:
        observed, v, noise = frame["_obs"].to_numpy(bool), frame["v"].to_numpy(float), frame[["_n1", "_n2"]].to_numpy().T
        at, times = pd.factorize(frame["t"], use_na_sentinel=False)
        there = ~observed & ~np.isnan(v)
        total, count = np.bincount(at[there], v[there], len(times)), np.bincount(at[there], minlength=len(times))
        information = lambda rows, b: _scored_information(v[rows], b, noise[:, rows], k)
        with np.errstate(invalid="ignore", divide="ignore"):
            i_o = information(observed, (total / count)[at[observed]])
            labels = frame.loc[~observed, ["_order", "series"]].dropna().drop_duplicates().sort_values(["_order", "series"])["series"][:most_members]
            each = []
            for one in labels.tolist():
                rows = np.flatnonzero(~observed & (frame["series"] == one).to_numpy())
                each.append(information(rows, (total[at[rows]] - v[rows]) / (count[at[rows]] - 1)))
        each = [i for i in each if i is not None]
        some = i_o is not None or len(each) > 0
        return pd.DataFrame({**{c: frame[c].iloc[:1] for c in by}, "i_o": [i_o], "i_m": [float(np.mean(each)) if each else None]})[: int(some)].astype({"i_o": float, "i_m": float})

    keys = ", ".join(f"{c} {kinds[c]}" for c in by)
    return lambdas(every.groupBy(*by).applyInPandas(found, f"{keys}, i_o double, i_m double"), by, floor)
