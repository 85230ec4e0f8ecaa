"""Special functions that Spark lacks, as column expressions; the normal quantile and digamma also of arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bernoulli terms of Stirling's series for the logarithm of the gamma function and for its derivative.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156)
DIGAMMA = (-1 / 12, 1 / 120, -1 / 252, 1 / 240, -1 / 132, 691 / 32760, -1 / 12)
SHIFT = 10

#: Wichura's published rational approximations (AS 241) of the normal quantile: centre, tail, far tail.
CENTRE = (
    (3.3871328727963666080, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
TAIL = (
    (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187, 1.67638483018380384940, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
FAR = (
    (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def _horner(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[-1])
    for c in coefficients[-2::-1]:
        out = out * x + F.lit(c)
    return out


def lgamma(x: Column) -> Column:
    """Logarithm of the gamma function for positive ``x``: Stirling's series from ``x + SHIFT`` and the recurrence down."""
    x = x.cast("double")
    z = x + SHIFT
    product = x
    for i in range(1, SHIFT):
        product = product * (x + i)
    return (z - 0.5) * F.log(z) - z + F.lit(0.9189385332046727418) + _horner(STIRLING, 1 / (z * z)) / z - F.log(product)


def digamma(x: Column) -> Column:
    """Derivative of ``lgamma`` for positive ``x``."""
    x = x.cast("double")
    z = x + SHIFT
    down = 1 / x
    for i in range(1, SHIFT):
        down = down + 1 / (x + i)
    return F.log(z) - 1 / (2 * z) + _horner(DIGAMMA, 1 / (z * z)) / (z * z) - down


def digammas(x: np.ndarray) -> np.ndarray:
    """``digamma`` of an array."""
    z = x + float(SHIFT)
    down = sum(1 / (x + i) for i in range(SHIFT))
    return np.log(z) - 1 / (2 * z) + np.polyval(DIGAMMA[::-1], 1 / (z * z)) / (z * z) - down


def normal_quantile(p: Column) -> Column:
    """The standard normal value below which a share ``p`` in (0, 1) lies."""
    q = p - 0.5
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    rational = lambda table, x: _horner(table[0], x) / _horner(table[1], x)
    outer = F.when(r <= 5, rational(TAIL, r - 1.6)).otherwise(rational(FAR, r - 5)) * F.signum(q)
    return F.when(F.abs(q) <= 0.425, q * rational(CENTRE, 0.180625 - q * q)).otherwise(outer)


def quantiles(p: np.ndarray) -> np.ndarray:
    """``normal_quantile`` of an array."""
    q, r = p - 0.5, np.sqrt(-np.log(np.minimum(p, 1 - p)))
    rational = lambda table, x: np.polyval(table[0][::-1], x) / np.polyval(table[1][::-1], x)
    outer = np.where(r <= 5, rational(TAIL, r - 1.6), rational(FAR, r - 5)) * np.sign(q)
    return np.where(np.abs(q) <= 0.425, q * rational(CENTRE, 0.180625 - q * q), outer)
