"""Bursts of news: sessions of a symbol's items that follow each other within a gap, from tables and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import DAY, stretch


def _sums(ts: str, item: str, score: str) -> list[Column]:
    first = F.min(F.struct(F.col(ts).alias("at"), F.col(item).alias("item")))
    return [first.alias("_first"), F.max(ts).alias("last_at"), F.count("*").alias("items"), F.sum(F.coalesce(F.col(score), F.lit(0.0))).alias("net_sentiment")]


def _shown(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.col("_first.at").alias("first_at"), "last_at", F.col("_first.item").alias("first_item"), "items", "net_sentiment")


def _window(ts: str, gap: Column) -> Column:
    return F.session_window(ts, F.concat(gap.cast("string"), F.lit(" seconds")))


def stream_sessions(items: DataFrame, gap: Column, delay: str = "2 hours", key: str = "symbol", ts: str = "published_at", item: str = "id", score: str = "sentiment_score") -> DataFrame:
    """Sessions of a stream: symbol, first_at, last_at, first_item, items, net_sentiment. ``gap``: seconds, an expression of the row, such as a gap per symbol.

    A session ends when no item follows within the gap; it comes out once the watermark has passed its end. Items later than the watermark are left out."""
    return _shown(items.withWatermark(ts, delay).groupBy(_window(ts, gap), key).agg(*_sums(ts, item, score)), key)


def sessions(items: DataFrame, gap: Column, key: str = "symbol", ts: str = "published_at", item: str = "id", score: str = "sentiment_score", seconds: int = DAY) -> DataFrame:
    """The same rows from a table. Sessions are made in stretches of ``seconds`` by symbol and then joined where one goes on in the next, so a symbol with a third of all news is many tasks, and
    what meets in one of them is a row a session and stretch. The gap has to be the same for all items of a symbol. Items without a moment are left out; a null symbol is one of its own."""
    each = items.where(F.col(ts).isNotNull()).withColumns({"_gap": gap.cast("long"), "_b": stretch(F.col(ts), seconds)})
    parts = each.groupBy(_window(ts, F.col("_gap")), key, "_b").agg(*_sums(ts, item, score), F.any_value("_gap").alias("_gap"))
    order = Window.partitionBy(key).orderBy("_first")
    apart = F.unix_micros(F.col("_first.at").cast("timestamp")) - F.unix_micros(F.lag("last_at").over(order).cast("timestamp"))
    parts = parts.withColumn("_new", F.coalesce(apart >= F.col("_gap") * 1_000_000, F.lit(True)))
    parts = parts.withColumn("_id", F.count_if("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = parts.groupBy(key, "_id").agg(F.min("_first").alias("_first"), F.max("last_at").alias("last_at"), F.sum("items").alias("items"), F.sum("net_sentiment").alias("net_sentiment"))
    return _shown(whole, key)
