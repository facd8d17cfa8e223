"""Small column expressions used throughout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def nz(x: Column | str) -> Column:
    """Null as 0.0, as the rules read missing indicators."""
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def number(x: Column) -> Column:
    """A double, null where the text is no finite number."""
    d = x.try_cast("double")
    return F.when(~F.isnan(d), d)


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once, however often f reads it; the optimiser would otherwise repeat x at each place."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def squeeze(x: Column) -> Column:
    """Trimmed, with every run of white space as one space."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def in_range(name: str, value: int, low: int, high: int) -> int:
    """value, or an error if a request asks for less or more than is allowed."""
    if not low <= value <= high:
        raise ValueError(f"{name} must be {low}..{high}")
    return value
