"""Bins, information measures and calendar arithmetic as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: At or below this, lambda of the model is taken as nothing, and a ratio over it is undefined.
FLOOR = 0.02
#: Information up to this is rounding.
ROUNDING = 1e-12


def bin_of(x: Column, low: Column, high: Column, bins: Column) -> Column:
    """The 0-based equal-width bin of ``x``: edges are ``k * step + low``, a bin holds its lower edge, the last one both.

    The quotient may round across an edge, so it is corrected by comparison with the edges themselves. A range without width is
    widened by a half on both sides.
    """
    flat = low == high
    low, high = F.when(flat, low - 0.5).otherwise(low), F.when(flat, high + 0.5).otherwise(high)
    step = (high - low) / bins
    first = F.least(F.floor((x - low) / step), bins - 1)
    lower = F.when((first > 0) & (x < first * step + low), first - 1).otherwise(first)
    return F.when((lower < bins - 1) & (x >= (lower + 1) * step + low), lower + 1).otherwise(lower).cast("int")


def fd_bins(span: Column, quartiles: Column, n: Column) -> Column:
    """Freedman-Diaconis bin count, truncated; null if the middle half has no spread."""
    middle = quartiles[1] - quartiles[0]
    return F.when(middle > 0, F.floor(span / (2 * middle / F.pow(n.cast("double"), F.lit(1 / 3))))).cast("int")


def n_bins(times: Column) -> Column:
    """Bins per axis for a number of times: the rounded cube root, at least 3."""
    return F.greatest(F.lit(3), F.floor(F.pow(times.cast("double"), F.lit(1 / 3)) + 0.5)).cast("int")


def bin_choices(times: int) -> tuple[int, int, int]:
    """Half, once and twice the usual bins."""
    usual = max(3, math.floor(times ** (1 / 3) + 0.5))
    return max(2, math.floor(usual / 2 + 0.5)), usual, 2 * usual


def lambda_bits(information: Column) -> Column:
    """Predictability from mutual information in bits; nothing, but for rounding, counts as nothing, null stays null."""
    return F.when(information > ROUNDING, F.sqrt(1 - F.pow(F.lit(2.0), -2 * information))).when(information.isNotNull(), 0.0)


def lambda_nats(information: Column) -> Column:
    return F.when(information > ROUNDING, F.sqrt(1 - F.exp(-2 * information))).when(information.isNotNull(), 0.0)


def ratio(observed: Column, model: Column, floor: float = FLOOR) -> Column:
    """observed / model, null where the model's value is no more than ``floor``."""
    return F.when(model > floor, observed / model)


def gauss_information(rho: Column) -> Column:
    """Bits of mutual information that a correlation has for Gaussian variables."""
    return -0.5 * F.log2(1 - F.pow(F.least(rho, F.lit(0.999999)), F.lit(2)))


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """The Wilson interval of a share, as struct (low, high) within [0, 1]."""
    p = hits / n
    scale = 1 + z * z / n
    centre, half = (p + z * z / (2 * n)) / scale, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    return F.struct(F.greatest(F.lit(0.0), centre - half).alias("low"), F.least(F.lit(1.0), centre + half).alias("high"))


def month_index(year: Column, month: Column) -> Column:
    return (year * 12 + month - 1).cast("int")


def month_label(index: Column) -> Column:
    return F.format_string("%04d-%02d", F.floor(index / 12).cast("int"), (F.pmod(index, F.lit(12)) + 1).cast("int"))


def month_of_year(index: Column) -> Column:
    return (F.pmod(index, F.lit(12)) + 1).cast("int")


def parse_leads(text: str) -> list[tuple[int, int]]:
    """Lead windows such as "2-4,13-60", or single leads, as inclusive pairs."""
    pairs = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        first, _, last = part.partition("-")
        pairs.append((int(first), int(last or first)))
        if pairs[-1][0] > pairs[-1][1] or pairs[-1][0] < 1:
            raise ValueError(f"not a lead window: {part}")
    return pairs
