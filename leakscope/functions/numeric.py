"""Rounding, ratios and money as column expressions.

Money columns are doubles holding whole cents.  They are summed as integer
cents, so a total never depends on the order in which partitions arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def as_col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ladder(steps: list[tuple[Column, object]], otherwise) -> Column:
    """Value of the first condition that holds."""
    out = F.when(*steps[0])
    for condition, value in steps[1:]:
        out = out.when(condition, value)
    return out.otherwise(otherwise)


def half_up(x: Column | str, digits: int) -> Column:
    """Round with .5 going up, also for negative numbers."""
    scale = float(10 ** digits)
    return F.floor(as_col(x) * scale + 0.5).cast("double") / scale


def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def ratio_or(numerator: Column, denominator: Column, default: float) -> Column:
    """numerator / denominator where the denominator is positive, else the default."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(default))


def or_default(x: Column | str, default) -> Column:
    """Default for a missing or zero value."""
    c = as_col(x)
    return F.when(c.isNull() | (c == 0), F.lit(default)).otherwise(c)


def cents(x: Column | str) -> Column:
    return F.floor(as_col(x) * 100.0 + 0.5).cast("bigint")


def from_cents(x: Column | str) -> Column:
    return as_col(x).cast("double") / 100.0


def sum_cents(x: Column | str) -> Column:
    """Exact total in cents; 0 for no rows."""
    return F.coalesce(F.sum(cents(x)), F.lit(0).cast("bigint"))


def sum_money(x: Column | str) -> Column:
    return from_cents(sum_cents(x))


def population_std(n: Column, total: Column, total_of_squares: Column) -> Column:
    """sqrt(n*Sxx - Sx*Sx) / n from exact integer sums given as DECIMAL(38,0)."""
    spread = n.cast("decimal(38,0)") * total_of_squares - total * total
    return F.sqrt(spread.cast("double")) / n.cast("double")


def sum_squared_cents(x: Column | str, over: WindowSpec | None = None) -> Column:
    """Exact total of squared cents as DECIMAL(38,0), of a group or a window.

    A square is cut into three 21-bit parts that are summed as long integers,
    so rows never touch decimals.  Amounts reach 30 million.  The spread multiplies
    the rows of a group with this total, and that product must stay below 1e38: 1e11 rows
    of 10,000 or 1e9 rows of a million each.  Beyond that it raises an error
    instead of wrapping.
    """
    c = cents(x)
    square, mask = c * c, (1 << 21) - 1
    parts = [F.shiftright(square, 42), F.shiftright(square, 21).bitwiseAND(mask),
             square.bitwiseAND(mask)]
    sums = [F.sum(p) if over is None else F.sum(p).over(over) for p in parts]
    high, middle, low = (s.cast("decimal(38,0)") for s in sums)
    return high * F.lit(1 << 42) + middle * F.lit(1 << 21) + low
