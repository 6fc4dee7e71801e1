"""Column helpers: day differences, literals, rounding and bucketing.

Two day-difference flavours exist on purpose (they disagree near bucket
edges): ``frac_days`` is the fractional difference that SQL date arithmetic
produces, ``whole_days`` is the floored whole-day count of a timedelta.
Both are plain column expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ts_lit(d: dt.date | dt.datetime) -> Column:
    """A ``timestamp_ntz`` literal (midnight for a date)."""
    if isinstance(d, dt.datetime):
        text = d.strftime("%Y-%m-%d %H:%M:%S")
    else:
        text = d.isoformat() + " 00:00:00"
    return F.lit(text).cast("timestamp_ntz")


_EPOCH_NTZ = "1970-01-01 00:00:00"


def micros(c) -> Column:
    """Microseconds since the epoch of a wall-clock (NTZ) timestamp.

    ``timestamp_diff`` on NTZ values does not depend on the session time
    zone (a cast to TIMESTAMP would, and day spans across a DST change
    would lose or gain an hour)."""
    return F.timestamp_diff("MICROSECOND", F.lit(_EPOCH_NTZ).cast("timestamp_ntz"), col_(c).cast("timestamp_ntz"))


def frac_days(a, b) -> Column:
    """Fractional days a - b (double)."""
    return (micros(a) - micros(b)) / F.lit(float(MICROS_PER_DAY))


def whole_days(a, b) -> Column:
    """Floored whole days of a - b (bigint); floor also for negative spans."""
    return F.floor((micros(a) - micros(b)) / F.lit(float(MICROS_PER_DAY))).cast("bigint")


def round_half_up(c, scale: int = 2) -> Column:
    """Round half-up on the decimal text of the value, returned as double.

    The value is first fixed to 6 decimals so that float noise from
    different summation orders cannot move it across a rounding edge.
    """
    return F.round(col_(c).cast("decimal(38,6)"), scale).cast("double")


def round_stat(c, scale: int = 6) -> Column:
    return F.round(col_(c).cast("decimal(38,10)"), scale).cast("double")


def pct(num, den) -> Column:
    """100 * num / den as double, NULL when den is 0, rounded half-up to 2."""
    return round_half_up(F.try_divide(F.lit(100.0) * col_(num).cast("double"), col_(den).cast("double")))


def line_value(quantity="quantity", price="price") -> Column:
    """Exact line value quantity * price (prices have two decimals)."""
    return (col_(quantity).cast("decimal(18,2)") * col_(price).cast("decimal(18,2)")).cast("decimal(18,2)")


def upper_bucket(value, bounds: Sequence[float], labels: Sequence[str]) -> tuple[Column, Column]:
    """CASE WHEN value <= b0 THEN l0 ... ELSE l_last; returns (label, order) columns."""
    v = col_(value)
    label = None
    order = None
    for i, b in enumerate(bounds):
        cond = v <= F.lit(b)
        label = F.when(cond, F.lit(labels[i])) if label is None else label.when(cond, F.lit(labels[i]))
        order = F.when(cond, F.lit(i + 1)) if order is None else order.when(cond, F.lit(i + 1))
    label = label.otherwise(F.lit(labels[len(bounds)]))
    order = order.otherwise(F.lit(len(bounds) + 1))
    return label, order


# A published Chebyshev fit of the complementary error function, relative error below 1.2e-7:
# erfc(x) = t exp(-x^2 + c0 + c1 t + c2 t^2 + ...) with t = 1 / (1 + x / 2), for x >= 0.
ERFC_COEFFICIENTS = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc(x: Column) -> Column:
    """Complementary error function as an expression (relative error below 1.2e-7); erfc(-x) = 2 - erfc(x)."""
    a = F.abs(x)
    t = 1.0 / (1.0 + 0.5 * a)
    poly = F.lit(ERFC_COEFFICIENTS[-1])
    for coefficient in reversed(ERFC_COEFFICIENTS[:-1]):
        poly = poly * t + F.lit(coefficient)
    tail = t * F.exp(poly - a * a)
    return F.when(x >= 0, tail).otherwise(2.0 - tail)


def two_sided_p(z: Column) -> Column:
    """Chance that a standard normal value is as far out as ``z`` (null for null, NaN for NaN)."""
    return F.when(z.isNotNull(), F.least(F.lit(1.0), erfc(F.abs(z) / F.lit(2.0 ** 0.5))))
