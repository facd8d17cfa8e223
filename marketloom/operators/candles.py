"""Candle series: resampling, dimensions, the latest rows, what indicators read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resample(ticks: DataFrame, unit: str, timeframe: str, symbol: str = "symbol", ts: str = "ts", price: str = "price", tie: str = "id") -> DataFrame:
    """Candles (symbol, timeframe, open_time, open, high, low, close, volume) from ticks: one partial aggregate and one shuffle."""
    at = F.struct(ts, tie)
    bucket = F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz")
    return (
        ticks.groupBy(F.col(symbol).alias("symbol"), F.lit(timeframe).alias("timeframe"), bucket.alias("open_time"))
        .agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count("*").cast("double").alias("volume"))
    )


def latest_n(candles: DataFrame, n: int = 300, key=("symbol", "timeframe")) -> DataFrame:
    """The n newest candles of every series. Spark cuts each partition to n rows a series before the shuffle."""
    newest = Window.partitionBy(*key).orderBy(F.col("open_time").desc(), *([F.col("provider_code").desc()] if "provider_code" in candles.columns else []))
    return candles.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= n).drop("_rank")


def with_dimensions(candles: DataFrame, assets: DataFrame, providers: DataFrame) -> DataFrame:
    """Candles with asset and provider columns. Dimensions are joined on ids; Spark broadcasts them while they are small."""
    return candles.join(assets, "asset_id").join(providers, "provider_id")


def series_frame(candles: DataFrame, limit: int | None = None) -> DataFrame:
    """What indicators read: all candles, or the latest ``limit``, with doubles, missing volume as 0, and t numbering a series from 1."""
    order = Window.partitionBy("symbol", "timeframe").orderBy("open_time", *(["provider_code"] if "provider_code" in candles.columns else []))
    typed = (candles if limit is None else latest_n(candles, limit)).withColumns({c: F.col(c).cast("double") for c in ("open", "high", "low", "close")} | {"volume": F.coalesce(F.col("volume").cast("double"), F.lit(0.0))})
    return typed.withColumn("t", F.row_number().over(order))


def price_change(candles: DataFrame, rows: int = 30, timeframe: str = "1h") -> DataFrame:
    """symbol and change_pct from the first to the last of the newest ``rows`` candles; series under 2 candles or starting at 0 are left out."""
    recent = latest_n(candles.where(F.col("timeframe") == timeframe), rows)
    ends = recent.groupBy("symbol").agg(F.min_by("close", "open_time").alias("first"), F.max_by("close", "open_time").alias("last"), F.count("*").alias("n"))
    return ends.where("n >= 2 and first <> 0").select("symbol", ((F.col("last") - F.col("first")) / F.col("first") * 100).alias("change_pct"))
