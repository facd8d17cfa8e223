"""The analysis of all series in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import in_range
from ..operators import candles as C
from ..operators import indicators as I
from ..operators import levels as L
from ..operators import rules as R

MIN_CANDLES, MAX_CANDLES = 60, 2000
#: What an analysis shows of the last row.
SNAPSHOT = ("ema_20", "ema_50", "ema_200", "rsi_14", "macd_line", "macd_signal", "macd_hist", "atr_14", "atr_pct", "bb_width", "adx_14", "sma_20", "volume_sma_20")


def _first(levels: str) -> Column:
    return F.get(F.col(levels), F.lit(0))["level"]


def latest_rows(candles: DataFrame, limit: int = 300) -> DataFrame:
    """The last row of every series with indicators, regime and levels."""
    frame = I.indicators(L.extremes(C.series_frame(candles, in_range("limit", limit, MIN_CANDLES, MAX_CANDLES))))
    rows = I.latest(frame, **L.collected()).where(F.col("n") >= MIN_CANDLES).withColumn("regime", R.regime())
    side = lambda c, below: L.near(F.col(c), F.col("n"), F.col("close"), below)
    return rows.withColumns({"supports": side("lows", True), "resistances": side("highs", False)}).drop("lows", "highs", "_low", "_high")


def rejected(candles: DataFrame, limit: int = 300) -> DataFrame:
    """Series that are too short, with their number of candles."""
    return C.latest_n(candles, limit).groupBy("symbol", "timeframe").agg(F.count("*").alias("n")).where(F.col("n") < MIN_CANDLES)


def analyze(candles: DataFrame, limit: int = 300) -> DataFrame:
    """One nested row per series: n, close, regime, supports, resistances, setups, score, indicators rounded to 8 places. Series under 60 candles are left out.

    Every step shares one partitioning by (symbol, timeframe); a series is at most ``limit`` <= 2000 rows, whatever its history."""
    df = latest_rows(candles, limit)
    df = df.withColumn("setups", R.setups(F.col("regime.label"), F.col("regime.confidence"), _first("supports"), _first("resistances")))
    df = df.withColumn("score", R.scores(F.col("regime.label"), F.col("setups")))
    shown = {c: F.round(c, 8) for c in SNAPSHOT}
    return df.withColumns(shown).select("symbol", "timeframe", "n", "open_time", "close", "regime", "supports", "resistances", "setups", "score", *SNAPSHOT)


def document(analysis: DataFrame) -> DataFrame:
    """symbol, timeframe and the analysis as JSON with ISO times."""
    return analysis.select("symbol", "timeframe", F.to_json(F.struct(*analysis.columns), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss'Z'"}).alias("document"))
