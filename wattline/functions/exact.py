"""Exact decimal arithmetic on readings: sums at storage precision, only results rounded.

The log stores power and voltage with 4 decimals, current with 6 and energy with
8 (SURVEY §1.2).  A value becomes an integer count of its last stored decimal,
sums of counts are decimals of up to 38 digits, and a ratio is rounded half-up
in integers, so results do not depend on summation order and ties do not flip.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decimals the log stores.
POWER = VOLTAGE = 4
CURRENT = 6
ENERGY = 8


def units(col: Column | str, decimals: int) -> Column:
    """Value as an integer count of 10**-decimals."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c * F.lit(10 ** decimals)).cast("long")


def total(u: Column | str) -> Column:
    """Aggregate: sum of integer counts; as a decimal it does not overflow."""
    c = F.col(u) if isinstance(u, str) else u
    return F.sum(c.cast("decimal(20,0)"))


def idiv(a: Column, b: Column | int) -> Column:
    """Floor division of non-negative longs, exact."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def ratio_rounded(num: Column, den: Column, num_decimals: int, out_decimals: int) -> Column:
    """round(num / den / 10**num_decimals, out_decimals), half-up, in integers.

    ``num`` is a sum of integer units, ``den`` a row count or weight sum.
    """
    return F.when(den > 0, ratio_units(num, den, num_decimals, out_decimals).cast("double") / F.lit(float(10 ** out_decimals)))


def ratio_units(num: Column, den: Column, num_decimals: int, out_decimals: int) -> Column:
    """As ratio_rounded, as an integer count (whole decimal) of 10**-out_decimals (``den`` positive)."""
    up = 10 ** max(0, out_decimals - num_decimals)
    step = 10 ** max(0, num_decimals - out_decimals)
    wide = num.cast("decimal(38,0)") * F.lit(2 * up).cast("decimal(20,0)") + den * F.lit(step)
    by = (den * F.lit(2 * step)).cast("decimal(38,0)")
    return ((wide - wide % by) / by).cast("decimal(38,0)")       # a whole quotient: exact


def avg_rounded(col: Column | str, in_decimals: int, out_decimals: int) -> Column:
    """Aggregate: exact half-up rounded mean of a column stored with ``in_decimals`` decimals."""
    c = F.col(col) if isinstance(col, str) else col
    return ratio_rounded(total(units(c, in_decimals)), F.count(c), in_decimals, out_decimals)


def units_rounded(u: Column, in_decimals: int, out_decimals: int) -> Column:
    """Integer units rounded half-up to ``out_decimals`` and returned as double."""
    return ratio_rounded(u, F.lit(1).cast("long"), in_decimals, out_decimals)


def spread_rounded(col: Column | str, in_decimals: int, out_decimals: int) -> Column:
    """Aggregate: round(max - min, out_decimals) computed on integer units."""
    c = F.col(col) if isinstance(col, str) else col
    u = units(c, in_decimals)
    return units_rounded(F.max(u) - F.min(u), in_decimals, out_decimals)


def fixed_text(u: Column, decimals: int) -> Column:
    """Non-negative integer units as fixed-point text ('%d.%0Nd'), engine-independent."""
    step = 10 ** decimals
    return F.format_string(f"%d.%0{decimals}d", idiv(u, F.lit(step)), u % step)


def current_e6(power: Column, voltage: Column) -> Column:
    """power / voltage in 1e-6 A, half-up, from centiwatts and decivolts."""
    cw = units(power, 2)
    dv = units(voltage, 1)
    return idiv(cw * 200000 + dv, dv * 2)
