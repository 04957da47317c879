"""Rounding, rates and coercion."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round2(value: Column | str) -> Column:
    """Two decimals, rounding the binary value (1.005 gives 1.0)."""
    return F.round(_col(value) * F.lit(100.0)) / F.lit(100.0)


def percent(part: Column, whole: Column) -> Column:
    """part / whole x 100 as double; NULL when whole is 0."""
    return part.cast("double") * F.lit(100.0) / F.nullif(whole.cast("double"), F.lit(0.0))


def percent2(part: Column, whole: Column) -> Column:
    return round2(percent(part, whole))


def count_when(condition: Column) -> Column:
    """Rows where the condition is true, as bigint (0 on an empty input)."""
    return F.count_if(F.coalesce(condition, F.lit(False)))


def to_number(column: Column | str) -> Column:
    """Text to double, with a comma accepted as decimal sign; NULL when it is no number."""
    return F.replace(_col(column).cast("string"), F.lit(","), F.lit(".")).try_cast("double")
