"""Regime, setups and scores of a series' latest row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.exprs import clamp, nz, ratio

# Labels, thresholds and the texts of reasons below are what readers of an analysis are promised.
RANGES, LOOSE = ("range", "range_compression"), ("range", "range_compression", "transition")
SETUP = "struct<setup_type:string,direction:string,triggered:boolean,score:double,reasons:array<string>,trigger_price:double,stop_hint:double,target_hint:double>"


def regime() -> Column:
    """STRUCT(label, confidence, adx, ema_gap_pct, ema_slope_pct, bb_width) from n, adx_14, ema_50, ema_200, ema_50_before and bb_width."""
    adx, e50, e200, width = (F.col(c) for c in ("adx_14", "ema_50", "ema_200", "bb_width"))
    gap = F.coalesce(ratio(e50 - e200, e200) * 100, F.lit(0.0))
    slope = F.when(F.col("n") > 5, F.coalesce(ratio(e50 - F.col("ema_50_before"), F.col("ema_50_before")) * 100, F.lit(0.0))).otherwise(0.0)
    sure = clamp(0.55 + F.least(adx / 100, F.lit(0.3)) + F.least(F.abs(gap) / 10, F.lit(0.15)), 0, 1)

    def out(label: str, confidence: Column, known: bool = True, all_known: bool = True) -> Column:
        null = F.lit(None).cast("double")
        return F.struct(F.lit(label).alias("label"), confidence.alias("confidence"), (adx if known else null).alias("adx"), (gap if all_known else null).alias("ema_gap_pct"), (slope if all_known else null).alias("ema_slope_pct"), (width if known else null).alias("bb_width"))

    return (
        F.when(F.col("n") < 30, out("insufficient_data", F.lit(0.0), False, False))
        .when(e50.isNull() | e200.isNull(), out("insufficient_data", F.lit(0.0), True, False))
        .when((adx >= 25) & (gap > 0) & (slope > 0), out("bull_trend", sure))
        .when((adx >= 25) & (gap < 0) & (slope < 0), out("bear_trend", sure))
        .when((adx < 18) & (width < 0.05), out("range_compression", F.lit(0.65)))
        .when(adx < 25, out("range", F.lit(0.58)))
        .otherwise(out("transition", F.lit(0.5)))
    )


def _setup(kind: str, direction: str, score: Column, reasons: list, price: Column, stop: Column, target: Column) -> Column:
    texts = F.array(*(r if isinstance(r, Column) else F.lit(r) for r in reasons))
    return F.struct(F.lit(kind).alias("setup_type"), F.lit(direction).alias("direction"), F.lit(True).alias("triggered"), score.alias("score"), texts.alias("reasons"), price.alias("trigger_price"), stop.alias("stop_hint"), target.alias("target_hint"))


def breakout(support: Column, resistance: Column) -> Column:
    """A close beyond the nearest level by a quarter percent that the close before had not passed; null levels never break."""
    close, before, volume, usual = nz("close"), nz("prev_close"), nz("volume"), nz("volume_sma_20")
    loud = (usual > 0) & (volume > usual * 1.2)
    score = F.least(62.0 + clamp(nz("adx_14") - 20.0, 0, 20) + F.when(loud, 8.0).otherwise(0.0), F.lit(99.0))
    more = F.when(loud, "Volume expansion detected.").otherwise("No strong volume expansion signal.")
    up = _setup("breakout", "bullish", score, ["Price closed above nearest resistance with threshold buffer.", "Breakout confirmation based on previous close below/at resistance.", more], close, resistance, close + (close - resistance) * 1.5)
    down = _setup("breakout", "bearish", score, ["Price closed below nearest support with threshold buffer.", "Breakdown confirmation based on previous close above/at support.", more], close, support, close - (support - close) * 1.5)
    return F.when((close > resistance * 1.0025) & (before <= resistance), up).when((close < support * 0.9975) & (before >= support), down)


def pullback(label: Column, confidence: Column) -> Column:
    """In a trend: the candle before reached EMA 20, and the close turned back within half an ATR of it."""
    close, before, ema, ema_before, low, high = (nz(c) for c in ("close", "prev_close", "ema_20", "prev_ema_20", "prev_low", "prev_high"))
    atr = F.greatest(nz("atr_14"), F.lit(1e-9))
    score, near = F.least(58.0 + confidence * 25.0, F.lit(96.0)), F.abs(close - ema) <= 0.5 * atr
    last = "Pullback stayed within ATR-guided bounds."
    up = _setup("pullback_continuation", "bullish", score, ["Bull trend regime confirmed.", "Price pulled back toward EMA20 and bounced.", last], close, low - 0.5 * atr, close + (close - low) * 1.8)
    down = _setup("pullback_continuation", "bearish", score, ["Bear trend regime confirmed.", "Price pulled back toward EMA20 and rejected.", last], close, high + 0.5 * atr, close - (high - close) * 1.8)
    return (
        F.when((label == "bull_trend") & (low <= ema_before + 0.2 * atr) & near & (close > before), up)
        .when((label == "bear_trend") & (high >= ema_before - 0.2 * atr) & near & (close < before), down)
    )


def mean_reversion(label: Column) -> Column:
    """Outside a trend: the close beyond a Bollinger band with an RSI to match."""
    close, rsi = nz("close"), nz("rsi_14")
    calm, last = label.isin(*LOOSE) | (nz("adx_14") < 25.0), "Regime is non-trending or transitional."
    score = lambda x: F.least(55.0 + x * 0.7, F.lit(92.0))
    up = _setup("mean_reversion", "bullish", score(35.0 - rsi), ["Price stretched below lower Bollinger Band.", "RSI indicates oversold conditions.", last], close, close * 0.99, nz("bb_middle"))
    down = _setup("mean_reversion", "bearish", score(rsi - 65.0), ["Price stretched above upper Bollinger Band.", "RSI indicates overbought conditions.", last], close, close * 1.01, nz("bb_middle"))
    return F.when(calm & (close < nz("bb_lower")) & (rsi <= 35), up).when(calm & (close > nz("bb_upper")) & (rsi >= 65), down)


def setups(label: Column, confidence: Column, support: Column, resistance: Column) -> Column:
    """ARRAY of the setups found, in the order breakout, pullback, mean reversion; empty under 25 candles."""
    found = F.array_compact(F.array(breakout(support, resistance), pullback(label, confidence), mean_reversion(label)))
    return F.when(F.col("n") >= 25, found).otherwise(F.array().cast(f"array<{SETUP}>"))


def scores(label: Column, found: Column) -> Column:
    """STRUCT(trend_score, momentum_score, volatility_score, setup_score, total_score), clamped to 0..100 and rounded."""
    e50, e200, rsi, hist, atr, width = (nz(c) for c in ("ema_50", "ema_200", "rsi_14", "macd_hist", "atr_pct", "bb_width"))
    trend = 50.0 + F.when(e50 > e200, 10.0).when(e50 < e200, -10.0).otherwise(0.0) + F.least(nz("adx_14"), F.lit(40.0)) * 0.5
    trend += F.when(label.isin("bull_trend", "bear_trend"), 10.0).when(label.isin(*RANGES), -5.0).otherwise(0.0)
    push = F.least(F.abs(hist) * 300.0, F.lit(15.0))
    momentum = 50.0 + F.when((rsi >= 45) & (rsi <= 60), 12.0).when((rsi < 30) | (rsi > 70), -8.0).otherwise(0.0) + F.when(hist > 0, push).otherwise(-push)
    volatility = 50.0 + F.when((atr >= 0.003) & (atr <= 0.03), 15.0).when(atr > 0.05, -15.0).otherwise(-5.0) + F.when((width >= 0.02) & (width <= 0.12), 10.0).when(width > 0.2, -10.0).otherwise(0.0)
    setup = F.coalesce(F.array_max(F.transform(found, lambda s: s["score"])), F.lit(35.0))
    total = 0.35 * trend + 0.25 * momentum + 0.15 * volatility + 0.25 * setup
    return F.struct(*(F.round(clamp(x, 0, 100), 2).alias(f"{n}_score") for n, x in (("trend", trend), ("momentum", momentum), ("volatility", volatility), ("setup", setup), ("total", total))))
