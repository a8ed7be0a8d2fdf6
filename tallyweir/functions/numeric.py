"""Null-preserving numeric kernels.

Spark's least and greatest skip nulls, which would turn "unknown" into a number; here
a null operand makes the result null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = Column | float | int


def col(value: Value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _all_known(*values: Column) -> Column:
    known = F.lit(True)
    for v in values:
        known = known & v.isNotNull()
    return known


def at_most(value: Value, cap: Value) -> Column:
    value, cap = col(value), col(cap)
    return F.when(_all_known(value, cap), F.least(value, cap))


def at_least(value: Value, floor: Value) -> Column:
    value, floor = col(value), col(floor)
    return F.when(_all_known(value, floor), F.greatest(value, floor))


def clamp(value: Value, low: Value, high: Value) -> Column:
    return at_most(at_least(value, low), high)


def minus_floor(a: Value, b: Value) -> Column:
    """a - b, not below 0 (unsigned saturating subtraction)."""
    return at_least(col(a) - col(b), 0)


def round2(value: Value) -> Column:
    """Two decimals; ties of the scaled double go away from zero (so 1.005 gives 1.0)."""
    return F.round(col(value).cast("double") * 100.0, 0) / 100.0


def over_free(value: Value, free: float, weight: float, cap: float) -> Column:
    """Pressure above a free allowance: min(max(value - free, 0) * weight, cap)."""
    return at_most(minus_floor(col(value).cast("double"), float(free)) * weight, float(cap))


def weighted(value: Value, weight: float, cap: float) -> Column:
    """min(value * weight, cap)."""
    return at_most(col(value).cast("double") * weight, float(cap))


def total(terms: Sequence[Column]) -> Column:
    """Sum that is null if a term is."""
    terms = list(terms)
    result = terms[0]
    for t in terms[1:]:
        result = result + t
    return result


def capped_sum(terms: Sequence[Column], cap: float) -> Column:
    return round2(at_most(total(terms), float(cap)))


def percent(part: Value, whole: Value, empty: float | None) -> Column:
    """100 * part / whole; ``empty`` for a zero whole (0, 100 or null, as the caller's convention is)."""
    part, whole = col(part).cast("double"), col(whole).cast("double")
    return F.when(whole == 0, F.lit(empty).cast("double")).otherwise(F.try_divide(100.0 * part, whole))


def ratio(part: Value, whole: Value) -> Column:
    """part / whole, null for a zero whole."""
    return F.try_divide(col(part).cast("double"), F.nullif(col(whole).cast("double"), F.lit(0.0)))


def band(value: Value, watch: float, high: float, extreme: float) -> Column:
    """stable, watch, high or extreme; each threshold belongs to its band. Null stays null."""
    value = col(value)
    return F.when(value >= extreme, "extreme").when(value >= high, "high").when(value >= watch, "watch").when(value.isNotNull(), "stable")


def bucket_count(value: Value) -> Column:
    value = col(value)
    return F.when(value <= 0, "0").when(value == 1, "1").when(value <= 3, "2-3").when(value <= 7, "4-7").when(value.isNotNull(), "8+")


def delta_percent(current: Value, baseline: Value) -> Column:
    """100 * (current - baseline) / baseline; null unless finite."""
    current, baseline = col(current).cast("double"), col(baseline).cast("double")
    delta = F.try_divide(100.0 * (current - baseline), F.nullif(baseline, F.lit(0.0)))
    return F.when(~F.isnan(delta) & (F.abs(delta) != float("inf")), delta)
