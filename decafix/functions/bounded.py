"""Bounded doubles as fixed-point BIGINT columns.

``fixed(x, p)`` is ``trunc(x * 2**d)`` with ``d = fraction_bits(p)``. Everything the engine filters or
aggregates is that integer, so Catalyst sees ordinary BIGINT expressions. NULL, NaN, infinities and
values with ``|x| * 2**d > 2**63`` have no fixed form and become NULL (2**63 itself is held as the greatest BIGINT).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_PRECISION = 11
_LONG = 2**63


def fraction_bits(precision: int) -> int:
    """Binary digits that hold ``precision`` decimal digits: the bound 0.49 * 10^-p needs -floor(log2(bound)) of them."""
    if not isinstance(precision, int) or not 0 <= precision <= MAX_PRECISION:
        raise ValueError(f"precision must be an int in 0..{MAX_PRECISION}: {precision!r}")
    return 0 if precision == 0 else -math.floor(math.log2(error_bound(precision)))


def error_bound(precision: int) -> float:
    return 0.49 * 10.0**-precision


def precision_of(scale: int) -> int:
    """The precision that a scale such as 10000 stands for; 0 and 1 stand for none."""
    digits = len(str(int(scale))) - 1 if scale else 0
    if scale not in (0, 10**digits):
        raise ValueError(f"scale must be a power of ten: {scale!r}")
    return digits


def fixed(x: Column | str, precision: int) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return (x.cast("double") * F.lit(float(2 ** fraction_bits(precision)))).try_cast("bigint")


def literal(value: float, precision: int) -> int:
    """A predicate's constant in the fixed domain, held inside BIGINT so that no comparison overflows."""
    if math.isnan(value):
        raise ValueError("NaN can't be compared")
    scaled = value * 2 ** fraction_bits(precision)
    return (_LONG - 1 if scaled > 0 else -_LONG) if math.isinf(scaled) else max(-_LONG, min(_LONG - 1, math.trunc(scaled)))


def decode(fx: Column, precision: int) -> Column:
    return fx.cast("double") / F.lit(float(2 ** fraction_bits(precision)))


def _threshold(k: int, precision: int, up: bool) -> float:
    """The double next to ``k`` (at or above it if ``up``, else at or below it), unscaled; scaling by a power of two is exact."""
    f = float(k)
    if (f < k) if up else (f > k):
        f = math.nextafter(f, math.inf if up else -math.inf)
    return f / 2 ** fraction_bits(precision)


def _at_least(x: Column, k: int, precision: int) -> Column:
    """``fixed(x) >= k`` as a comparison of the column itself: truncation is toward zero, so a k of 0 or less is reached from above k - 1."""
    return x > F.lit(_threshold(k - 1, precision, False)) if -(2**53) < k <= 0 else x >= F.lit(_threshold(k, precision, True))


def _at_most(x: Column, k: int, precision: int) -> Column:
    return x < F.lit(_threshold(k + 1, precision, True)) if 0 <= k < 2**53 else x <= F.lit(_threshold(k, precision, False))


def _range(x: Column | str, low: int, high: int, precision: int) -> Column:
    """``low <= fixed(x) <= high`` without computing it: two comparisons that reach the Parquet scan and its statistics. A null is null; NaN, infinities and
    values without a fixed form are outside (NaN is above all numbers in Spark's order)."""
    x = (F.col(x) if isinstance(x, str) else x).cast("double")
    if low >= _LONG or high < -_LONG:
        return F.lit(False)
    limit = 2.0 ** (63 - fraction_bits(precision))
    above = x >= F.lit(-limit) if low <= -_LONG else _at_least(x, low, precision)
    below = x <= F.lit(limit) if high >= _LONG - 1 else _at_most(x, high, precision)
    return above & below


def gt(x: Column | str, value: float, precision: int) -> Column:
    return _range(x, literal(value, precision) + 1, _LONG - 1, precision)


def lt(x: Column | str, value: float, precision: int) -> Column:
    return _range(x, -_LONG, literal(value, precision) - 1, precision)


def eq(x: Column | str, value: float, precision: int) -> Column:
    return _range(x, literal(value, precision), literal(value, precision), precision)


def between(x: Column | str, low: float, high: float, precision: int) -> Column:
    """The open interval."""
    return _range(x, literal(low, precision) + 1, literal(high, precision) - 1, precision)


def is_bounded(a: Column, b: Column, precision: int) -> Column:
    return F.abs(a - b) < F.lit(error_bound(precision))


def components(x: Column | str, precision: int) -> dict[str, Column]:
    """The integer part (floor) and the fraction bits above it, of the exact fixed-point value."""
    fx, d = fixed(x, precision), fraction_bits(precision)
    return {"whole": F.shiftright(fx, d), "fraction": fx.bitwiseAND(F.lit((1 << d) - 1))}
