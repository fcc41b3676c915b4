"""Initial values of weights as column expressions: a value is a function of the seed, its blob and its place alone."""

from __future__ import annotations

from collections.abc import Sequence
from math import prod, sqrt

from pyspark.sql import Column, functions as F

from gradloom.plans.net import Filler

# Acklam's rational approximation of the inverse normal distribution (relative error 1.2e-9), highest powers first:
# numerator and denominator of the middle part, then of the tails below TAIL; and the share of a normal law below two deviations.
MIDDLE = ((-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00),
          (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01, -1.328068155288572e+01, 1.0))
TAILS = ((-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00),
         (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00, 1.0))
TAIL = 0.02425
BELOW_TWO = 0.022750131948179195


def polynomial(factors: Sequence[float], x: Column) -> Column:
    total = F.lit(factors[0])
    for factor in factors[1:]:
        total = total * x + F.lit(factor)
    return total


def inverse_normal(p: Column) -> Column:
    """The deviate below which a normal law has the share p, for 0 < p < 1."""
    q = p - F.lit(0.5)
    low = F.sqrt(F.lit(-2.0) * F.ln(F.least(p, F.lit(1.0) - p)))
    tail = polynomial(TAILS[0], low) / polynomial(TAILS[1], low)
    middle = polynomial(MIDDLE[0], q * q) * q / polynomial(MIDDLE[1], q * q)
    return F.when(p < TAIL, tail).when(p > 1 - TAIL, -tail).otherwise(middle)


def uniform(seed: int, layer: Column, blob: Column, place: Column) -> Column:
    """Uniform in (0, 1) with 48 bits of the MD5 of `seed/layer/blob/place`."""
    digest = F.md5(F.concat_ws("/", F.lit(str(seed)), layer, blob.cast("string"), place.cast("string")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def filler_value(filler: Filler, shape: Sequence[int], u: Column) -> Column:
    """A filler's value from a uniform one; `shape` is that of the blob."""
    if filler.kind == "constant":
        return F.lit(float(filler.value))
    if filler.kind == "gaussian":
        return F.lit(float(filler.std)) * inverse_normal(u)
    if filler.kind == "truncated":
        return F.lit(float(filler.std)) * inverse_normal(F.lit(BELOW_TWO) + u * F.lit(1 - 2 * BELOW_TWO))
    if filler.kind == "xavier":
        return (F.lit(2.0) * u - F.lit(1.0)) * F.lit(sqrt(3.0 / prod(shape[1:])))
    raise ValueError(f"unknown filler {filler.kind}")
