"""Number expressions with the intended handling of zero and NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_percent(part: Column, whole: Column) -> Column:
    """Whole percentage, truncated toward zero; 0 when the denominator is zero or unknown."""
    return F.coalesce(F.when(whole != 0, F.call_function("div", part * 100, whole)), F.lit(0))


def guarded_ratio(part: Column, whole: Column) -> Column:
    """Floating-point ratio, NULL when the denominator is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def clamp_at_zero(value: Column) -> Column:
    """Negative values become 0 while NULL stays NULL."""
    return F.when(value < 0, F.lit(0).cast("bigint")).otherwise(value)


def zero_if_null(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))
