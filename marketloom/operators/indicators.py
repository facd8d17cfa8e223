"""Technical indicators of all series at once, over one partitioning and one order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ewm import KEY, span, with_ew
from ..functions.exprs import ratio

WILDER = 1 / 14


def _last20():
    return Window.partitionBy(*KEY).orderBy("t").rowsBetween(-19, 0)


def _lag(c: str, n: int = 1) -> Column:
    return F.lag(c, n).over(Window.partitionBy(*KEY).orderBy("t"))


def _full(x: Column) -> Column:
    """Null until 20 rows are there."""
    return F.when(F.col("t") >= 20, x)


def averages(frame: DataFrame) -> DataFrame:
    return frame.withColumns({"sma_20": _full(F.avg("close").over(_last20())), "volume_sma_20": _full(F.avg("volume").over(_last20()))})


def bollinger(frame: DataFrame) -> DataFrame:
    """The 20-row mean, two population deviations around it, and their width in proportion to the close."""
    frame = frame.withColumns({"bb_middle": _full(F.avg("close").over(_last20())), "_dev": _full(F.stddev_pop("close").over(_last20()))})
    frame = frame.withColumns({"bb_upper": F.col("bb_middle") + 2 * F.col("_dev"), "bb_lower": F.col("bb_middle") - 2 * F.col("_dev")})
    return frame.withColumn("bb_width", ratio(F.col("bb_upper") - F.col("bb_lower"), F.col("close"))).drop("_dev")


def movements(frame: DataFrame) -> DataFrame:
    """true_range, gain, loss, plus_dm and minus_dm. Of a series' first row the true range is high - low, gain and loss are null, movements 0."""
    up, down, step = F.col("high") - _lag("high"), _lag("low") - F.col("low"), F.col("close") - _lag("close")
    frame = frame.withColumns({"_up": up, "_down": down, "_step": step, "_pc": _lag("close")})
    spread = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_pc")), F.abs(F.col("low") - F.col("_pc")))
    signed = lambda a, b: F.coalesce(F.when((F.col(a) > F.col(b)) & (F.col(a) > 0), F.col(a)), F.lit(0.0))
    some = F.col("_step").isNotNull()
    return frame.withColumns({"true_range": spread, "gain": F.when(some, F.greatest("_step", F.lit(0.0))), "loss": F.when(some, F.greatest(-F.col("_step"), F.lit(0.0))), "plus_dm": signed("_up", "_down"), "minus_dm": signed("_down", "_up")}).drop("_up", "_down", "_step", "_pc")


#: Means by name: input, weight, least number of observations. Those of a group read only columns that stand before it.
EMAS = {f"ema_{n}": ("close", span(n), 1) for n in (20, 50, 200)}
MACD = {"_e12": ("close", span(12), 1), "_e26": ("close", span(26), 1)}
STRENGTH = {n: (x, WILDER, 14) for n, x in (("_gain", "gain"), ("_loss", "loss"), ("atr_14", "true_range"), ("_plus", "plus_dm"), ("_minus", "minus_dm"))}
SIGNAL, ADX = {"macd_signal": ("macd_line", span(9), 1)}, {"adx_14": ("_dx", WILDER, 14)}


def _macd_line(frame: DataFrame) -> DataFrame:
    return frame.withColumn("macd_line", F.col("_e12") - F.col("_e26")).drop("_e12", "_e26")


def _histogram(frame: DataFrame) -> DataFrame:
    return frame.withColumn("macd_hist", F.col("macd_line") - F.col("macd_signal"))


def _directions(frame: DataFrame) -> DataFrame:
    di = lambda c: 100 * ratio(F.col(c), F.col("atr_14"))
    frame = frame.withColumns({"rsi_14": 100 - 100 / (1 + ratio(F.col("_gain"), F.col("_loss"))), "atr_pct": ratio(F.col("atr_14"), F.col("close")), "plus_di": di("_plus"), "minus_di": di("_minus")})
    return frame.withColumn("_dx", 100 * ratio(F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di"))).drop("_gain", "_loss", "_plus", "_minus")


def emas(frame: DataFrame) -> DataFrame:
    return with_ew(frame, EMAS)


def macd(frame: DataFrame) -> DataFrame:
    return _histogram(with_ew(_macd_line(with_ew(frame, MACD)), SIGNAL))


def strength(frame: DataFrame) -> DataFrame:
    """rsi_14, atr_14, atr_pct, plus_di, minus_di and adx_14 of a frame with movements. RSI is null where no loss was seen."""
    return with_ew(_directions(with_ew(frame, STRENGTH)), ADX).drop("_dx")


def indicators(frame: DataFrame) -> DataFrame:
    """A series frame with every indicator. The means are taken in two goes, those that others are made of first."""
    frame = movements(bollinger(averages(frame)))
    frame = _directions(_macd_line(with_ew(frame, EMAS | MACD | STRENGTH)))
    return _histogram(with_ew(frame, SIGNAL | ADX)).drop("_dx")


def latest(frame: DataFrame, **more: Column) -> DataFrame:
    """One row per series: its last candle with indicators, the previous candle's values the rules read, n, and further aggregates by name."""
    frame = frame.withColumns({f"prev_{c}": _lag(c) for c in ("close", "low", "high", "ema_20")} | {"ema_50_before": _lag("ema_50", 5)})
    last = F.max_by(F.struct(*[c for c in frame.columns if c not in KEY]), "t").alias("last")
    return frame.groupBy(*KEY).agg(last, F.count("*").alias("n"), *(x.alias(name) for name, x in more.items())).select(*KEY, "n", "last.*", *more)
