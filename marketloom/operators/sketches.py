"""Distributions and distinct counts of days, as sketches that are stored once and merged over any span."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ewm import KEY

#: Size of a quantile sketch, and the logarithm of the buckets of a distinct count.
K, LG = 1024, 12


def rank_error(k: int = K) -> float:
    """The share of rows by which the rank of a quantile is off at most, at 99 percent: the bound published for this sketch. Up to k rows it is exact."""
    return 2.296 / k**0.9723


def distinct_error(lg: int = LG) -> float:
    """Three standard errors of a merged distinct count, as a share of it."""
    return 3 * 1.04 / 2 ** (lg / 2)


def daily(rows: DataFrame, values: tuple[str, ...], distinct: tuple[str, ...] = (), key: tuple[str, ...] = KEY, at: str = "open_time", k: int = K, lg: int = LG) -> DataFrame:
    """A row per key and day: n, kll_<value> and hll_<column> sketches. Nulls count for nothing, NaN neither. One partial aggregate, whose sketches meet in one shuffle: a hot key is a sketch a task."""
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    quantiles = [F.kll_sketch_agg_double(number(c), k).alias(f"kll_{c}") for c in values]
    counts = [F.hll_sketch_agg(F.col(c), lg).alias(f"hll_{c}") for c in distinct]
    return rows.groupBy(*key, F.to_date(at).alias("day")).agg(F.count("*").alias("n"), *quantiles, *counts)


def span(days: DataFrame, first: Column, last: Column, key: tuple[str, ...] = KEY) -> DataFrame:
    """A row per key: the sketches of the days from first to last, merged. Rows of several stores or of late batches of one day merge alike."""
    kll, hll = ([c for c in days.columns if c.startswith(p)] for p in ("kll_", "hll_"))
    inside = days.where((F.col("day") >= first) & (F.col("day") <= last))
    return inside.groupBy(*key).agg(F.sum("n").alias("n"), *(F.kll_merge_agg_double(c).alias(c) for c in kll), *(F.hll_union_agg(c).alias(c) for c in hll))


def bands(merged: DataFrame, shares: tuple[float, ...] = (0.1, 0.5, 0.9), key: tuple[str, ...] = KEY) -> DataFrame:
    """key, n, for each value ARRAY of the quantiles at ``shares`` (null without values), and for each counted column its number of distinct values."""
    kll, hll = ([c for c in merged.columns if c.startswith(p)] for p in ("kll_", "hll_"))
    some = lambda c: F.coalesce(F.kll_sketch_get_n_double(c), F.lit(0)) > 0
    quantiles = [F.when(some(c), F.array(*(F.kll_sketch_get_quantile_double(F.col(c), F.lit(p)) for p in shares))).alias(c[4:]) for c in kll]
    return merged.select(*key, "n", *quantiles, *(F.hll_sketch_estimate(c).alias(f"distinct_{c[4:]}") for c in hll))
