"""Candles and headlines from streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.upsert import upsert


def stream_candles(ticks: DataFrame, window: str = "1 hour", delay: str = "2 hours", symbol: str = "symbol", ts: str = "ts", price: str = "price", tie: str = "id") -> DataFrame:
    """Candles of a stream of ticks in tumbling windows; state is kept until the watermark passes a window's end."""
    at = F.struct(ts, tie)
    grouped = ticks.withWatermark(ts, delay).groupBy(F.window(ts, window).alias("w"), F.col(symbol).alias("symbol"))
    out = grouped.agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count("*").cast("double").alias("volume"))
    return out.select("symbol", F.col("w.start").alias("open_time"), F.col("w.end").alias("close_time"), "open", "high", "low", "close", "volume")


def stream_headlines(headlines: DataFrame, delay: str = "2 hours") -> DataFrame:
    """The first headline of every dedup key within the watermark."""
    return headlines.withWatermark("published_at", delay).dropDuplicatesWithinWatermark(["dedup_key"])


def versions(spark: SparkSession, path: str, day: str) -> list[int]:
    """The versions of one day of a store, ascending: one listing of that day's folder, in any store that Spark reaches."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/day={day}")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n.split("=")[1]) for n in found if n.startswith("version="))


def _drop(spark: SparkSession, path: str, day: str, version: int) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/day={day}/version={version}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def read_store(spark: SparkSession, path: str, schema: str, days: list[str] | None = None, before: int | None = None) -> DataFrame:
    """The rows of a store that into_store writes, with day: of each day its newest version, or the newest before batch ``before``. Empty if nothing is stored yet.

    With ``days`` (yyyy-mm-dd, few) only the folders of these days are listed and read."""
    if days is not None:
        newest = {d: [v for v in versions(spark, path, d) if before is None or v < before][-1:] for d in days}
        folders = [f"{path}/day={d}/version={v[0]}" for d, v in newest.items() if v]
        if not folders:
            return spark.createDataFrame([], f"{schema}, day date")
        return spark.read.schema(f"{schema}, day date, version long").option("basePath", path).parquet(*folders).drop("version")
    try:
        rows = spark.read.schema(f"{schema}, day date, version long").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, day date")
    if before is not None:
        rows = rows.where(F.col("version") < before)
    newest = rows.groupBy("day").agg(F.max("version").alias("version"))
    return rows.join(newest, ["day", "version"], "left_semi").drop("version")


def into_store(path: str, key: tuple[str, ...], values: tuple[str, ...], at: str = "open_time") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: late candles correct stored ones. Only the days that a batch touches are listed, read and written.

    A day's rows are a folder by batch id, day=.../version=..., and the newest one counts (see read_store). A repeated batch writes the same
    folders again from the versions before it. Of a touched day the version that the batch reads and the one that it writes stay, older ones are removed: batches before are committed by then.
    Rows without a key or moment are stored under the day of the default partition. The days of a batch are gathered on the driver, as many as its rows are late by."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.select(*key, *values, F.to_date(at).alias("day"))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.select(*key, *values).schema.fields)
        days = ["__HIVE_DEFAULT_PARTITION__" if r.day is None else str(r.day) for r in new.select("day").distinct().collect()]
        stored = read_store(spark, path, schema, days, batch_id)
        after = upsert(stored, new, (*key, "day"), values).drop("action").withColumn("version", F.lit(batch_id).cast("long"))
        after.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "version").parquet(path)
        for day in days:
            for old in [v for v in versions(spark, path, day) if v < batch_id][:-1]:
                _drop(spark, path, day, old)

    return write
