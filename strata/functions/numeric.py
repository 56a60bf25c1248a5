"""Numeric helpers that keep Spark's ANSI mode from raising and round as the data model asks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a numeric text may look like; Spark's cast also takes suffixes such as ``1d``.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def bin_to(value: Column | str, width: float) -> Column:
    """Nearest multiple of ``width``, halves to even; negative zero becomes zero."""
    value = F.col(value) if isinstance(value, str) else value
    return F.rint(value / F.lit(float(width))) * F.lit(float(width)) + F.lit(0.0)


def to_double(value: Column) -> Column:
    """A number, or null where the text holds none (also for NaN)."""
    text = value.cast("string")
    parsed = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return F.when(~F.isnan(parsed), parsed)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))
