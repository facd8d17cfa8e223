"""Swing points, and support and resistance from clusters of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ewm import KEY

SIDE, TOLERANCE, KEEP = 3, 0.003, 5


def swings(frame: DataFrame) -> DataFrame:
    """frame with swing_high and swing_low: the value where it is the extreme of the rows around it, ties included, and null elsewhere."""
    around = Window.partitionBy(*KEY).orderBy("t").rowsBetween(-SIDE, SIDE)
    frame = frame.withColumns({"_n": F.count("*").over(Window.partitionBy(*KEY)), "_max": F.max("high").over(around), "_min": F.min("low").over(around)})
    inner = (F.col("t") > SIDE) & (F.col("t") <= F.col("_n") - SIDE)
    return frame.withColumns({"swing_high": F.when(inner & (F.col("high") == F.col("_max")), F.col("high")), "swing_low": F.when(inner & (F.col("low") == F.col("_min")), F.col("low"))}).drop("_n", "_max", "_min")


def clusters(values: Column, tolerance: float = TOLERANCE) -> Column:
    """ARRAY(STRUCT(price, touches)): ascending values join the last cluster while they are within tolerance of its running mean."""
    kind = "array<struct<price:double,touches:int>>"
    start = F.struct(F.array().cast(kind).alias("done"), F.lit(0.0).alias("total"), F.lit(0).alias("n"))
    closed = lambda acc: F.when(acc["n"] > 0, F.concat(acc["done"], F.array(F.struct((acc["total"] / acc["n"]).alias("price"), acc["n"].alias("touches"))))).otherwise(acc["done"])

    def step(acc: Column, x: Column) -> Column:
        mean = acc["total"] / F.nullif(acc["n"], F.lit(0))
        near = F.coalesce(F.abs(x - mean) / F.nullif(mean, F.lit(0.0)), F.lit(0.0)) <= tolerance
        joined = F.struct(acc["done"].alias("done"), (acc["total"] + x).alias("total"), (acc["n"] + 1).alias("n"))
        return F.when(near, joined).otherwise(F.struct(closed(acc).alias("done"), x.alias("total"), F.lit(1).alias("n")))

    return F.aggregate(F.array_sort(values), start, step, closed)


def extremes(frame: DataFrame) -> DataFrame:
    """frame with _low and _high: the value where it is the extreme of the rows around it, and null elsewhere. The last rows of a series are still to be left out."""
    around = Window.partitionBy(*KEY).orderBy("t").rowsBetween(-SIDE, SIDE)
    at = lambda c, best: F.when((F.col("t") > SIDE) & (F.col(c) == best(c).over(around)), F.struct("t", F.col(c).alias("value")))
    return frame.withColumns({"_low": at("low", F.min), "_high": at("high", F.max)})


def near(swings: Column, n: Column, close: Column, below: bool) -> Column:
    """ARRAY(STRUCT(level, touches, distance_pct)): the nearest five clusters of swing points on one side of the close, from the collected _low or _high of a series of n rows."""
    values = F.transform(F.filter(swings, lambda x: x["t"] <= n - SIDE), lambda x: x["value"])
    side = F.filter(clusters(values), lambda c: c["price"] < close if below else c["price"] > close)
    side = F.reverse(side) if below else side
    return F.transform(F.slice(side, 1, KEEP), lambda c: F.struct(F.round(c["price"], 8).alias("level"), c["touches"].alias("touches"), F.round((c["price"] - close) / F.nullif(close, F.lit(0.0)) * 100, 4).alias("distance_pct")))


def collected() -> dict[str, Column]:
    """Aggregates over a frame with extremes that near() reads. All swing points of a series are collected: an analysis has at most 2000 rows of it."""
    return {"lows": F.collect_list("_low"), "highs": F.collect_list("_high")}


def levels(frame: DataFrame) -> DataFrame:
    """One row per series: supports and resistances, ARRAY(STRUCT(level, touches, distance_pct)), the nearest five of each to the last close."""
    found = extremes(frame).groupBy(*KEY).agg(F.max_by("close", "t").alias("close"), F.count("*").alias("n"), *(x.alias(c) for c, x in collected().items()))
    return found.select(*KEY, near(F.col("lows"), F.col("n"), F.col("close"), True).alias("supports"), near(F.col("highs"), F.col("n"), F.col("close"), False).alias("resistances"))
