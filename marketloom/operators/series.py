"""What runs along a series of candles: coarser candles and trends over timeframes, drawdown episodes, breaks of structure, the regime of volatility."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ewm import KEY
from .joins import DAY, stretch
from .levels import SIDE

#: Timeframes of a cascade and their seconds.
COARSER = {"4h": 14_400, "1d": DAY}


# ---- coarser candles ----


def _opens(seconds: int) -> Column:
    """The moment at which the candle of so many seconds opens in which a moment lies, counted from midnight UTC."""
    return F.timestamp_micros(stretch(F.col("open_time"), seconds) * F.lit(seconds * 1_000_000))


def cascade(candles: DataFrame, timeframes: dict[str, int] = COARSER, symbol: str = "symbol") -> DataFrame:
    """symbol, timeframe, open_time, open, high, low, close, volume and candles (how many went in) of all ``timeframes``, from finer stored candles in one scan.

    A candle is a mergeable aggregate: the first open and last close by time, extremes and sums; so finer candles give what the ticks would, and partial sums meet in one shuffle
    for all timeframes (grouping sets). Of finer candles that open at one moment (of several providers) the greatest row is last, the least first. Open times without candles
    have none; see ``filled``. Null prices don't count, a null volume is 0."""
    names = list(timeframes)
    df = candles.withColumns({f"_at_{n}": _opens(s) for n, s in timeframes.items()})
    first, last = (F.struct("open_time", c) for c in ("open", "close"))
    sets = df.groupingSets([[df[symbol], df[f"_at_{n}"]] for n in names], df[symbol], *(df[f"_at_{n}"] for n in names))
    known = lambda at, c: F.when(F.col(c).isNotNull(), at)
    out = sets.agg(
        F.grouping_id().alias("_set"), F.min(known(first, "open")).alias("_first"), F.max("high").alias("high"), F.min("low").alias("low"), F.max(known(last, "close")).alias("_last"),
        F.sum(F.coalesce("volume", F.lit(0.0))).alias("volume"), F.count("*").alias("candles"),
    )
    width = len(names)
    # a set's id has a bit for each column that it leaves out, the last column's lowest
    which = {n: sum(1 << (width - 1 - k) for k in range(width) if k != j) for j, n in enumerate(names)}
    timeframe = F.coalesce(*(F.when(F.col("_set") == i, F.lit(n)) for n, i in which.items()))
    open_time = F.coalesce(*(F.when(F.col("_set") == i, F.col(f"_at_{n}")) for n, i in which.items()))
    kind = candles.schema["open_time"].dataType
    return out.select(symbol, timeframe.alias("timeframe"), open_time.cast(kind).alias("open_time"), F.col("_first.open").alias("open"), "high", "low", F.col("_last.close").alias("close"), "volume", "candles")


def filled(candles: DataFrame, timeframes: dict[str, int] = COARSER, key: tuple[str, ...] = KEY) -> DataFrame:
    """candles with rows for the open times that a series misses between two of its candles: all prices at the close before, volume and candles 0, filled true.

    A row knows the next one and makes the rows up to it, so nothing is joined; timeframes that aren't listed are left as they are."""
    after = F.lead("open_time").over(Window.partitionBy(*key).orderBy("open_time"))
    seconds = F.coalesce(*(F.when(F.col("timeframe") == n, F.lit(s).cast("long")) for n, s in timeframes.items()))
    gaps = F.greatest(F.lit(0), F.floor((F.unix_micros(after.cast("timestamp")) - F.unix_micros(F.col("open_time").cast("timestamp")) - 1) / (seconds * 1_000_000)))
    each = candles.withColumn("_gaps", F.coalesce(gaps.cast("int"), F.lit(0))).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_gaps"))))
    made, kind = F.col("_k") > 0, candles.schema["open_time"].dataType
    at = F.timestamp_micros(F.unix_micros(F.col("open_time").cast("timestamp")) + F.col("_k") * seconds * 1_000_000).cast(kind)
    prices = {c: F.when(made, F.col("close")).otherwise(F.col(c)) for c in ("open", "high", "low")}
    counts = {c: F.when(made, F.lit(0).cast(candles.schema[c].dataType)).otherwise(F.col(c)) for c in ("volume", "candles") if c in candles.columns}
    return each.withColumns({"open_time": F.when(made, at).otherwise(F.col("open_time"))} | prices | counts | {"filled": made}).drop("_gaps", "_k")


def trends(candles: DataFrame, rows: int = 3, symbol: str = "symbol") -> DataFrame:
    """A row per symbol: trends, MAP of timeframe to 1, 0 or -1, the sign of the newest close less that ``rows`` candles before it, and alignment: up or down where all of them say so, else mixed.

    A timeframe with fewer candles isn't in the map. Spark cuts each partition to the newest rows of a series before the shuffle."""
    newest = Window.partitionBy(symbol, "timeframe").orderBy(F.col("open_time").desc())
    recent = candles.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= rows + 1)
    ends = recent.groupBy(symbol, "timeframe").agg(F.max(F.when(F.col("_rank") == 1, F.col("close"))).alias("now"), F.max(F.when(F.col("_rank") == rows + 1, F.col("close"))).alias("then"))
    each = ends.where("now is not null and then is not null").withColumn("trend", F.signum(F.col("now") - F.col("then")).cast("int"))
    out = each.groupBy(symbol).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("timeframe", "trend")))).alias("trends"), F.min("trend").alias("_least"), F.max("trend").alias("_most"))
    alignment = F.when(F.col("_least") == 1, "up").when(F.col("_most") == -1, "down").otherwise("mixed")
    return out.select(symbol, "trends", alignment.alias("alignment"))


# ---- drawdowns ----


def drawdowns(candles: DataFrame, key: tuple[str, ...] = KEY, at: str = "open_time", price: str = "close", seconds: int = 30 * DAY) -> DataFrame:
    """An episode a row: key, peak_at, peak, start_at (the first row below the peak), trough_at, trough (the first lowest row), recovered_at (the first row at the peak again, null if there is none yet), depth_pct, rows (below the peak).

    A close equal to the peak is no drawdown and ends one. Rows without a price are passed over; of several at one moment the higher comes first. depth_pct is null where the peak is 0.
    Running maxima and the last peak are taken within stretches of ``seconds`` and carried on by a row a stretch, and an episode is an aggregate: a series of decades is many tasks."""
    rows = candles.where(F.col(price).isNotNull()).select(*key, F.col(at).alias("_at"), F.col(price).alias("_price"), stretch(F.col(at), seconds).alias("_b"))
    order = [F.col("_at"), F.col("_price").desc()]
    here, before = (Window.partitionBy(*key, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, end) for end in (0, -1))

    def carried(df: DataFrame, of: Column, over: Column, name: str) -> DataFrame:
        """df with what its stretch takes on from earlier ones."""
        ends = df.groupBy(*key, "_b").agg(of.alias("_end")).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)), "_b", "_end").withColumnRenamed("_b", "_bb")
        ends = ends.withColumn(name, over.over(Window.partitionBy(*(f"_k{i}" for i in range(len(key)))).orderBy("_bb").rowsBetween(Window.unboundedPreceding, -1))).drop("_end")
        on = df["_b"] == ends["_bb"]
        for i, k in enumerate(key):
            on = on & df[k].eqNullSafe(ends[f"_k{i}"])
        return df.join(ends, on).drop("_bb", *(f"_k{i}" for i in range(len(key))))

    df = carried(rows, F.max("_price"), F.max("_end"), "_top")
    df = df.withColumn("_peak", F.greatest(F.max("_price").over(here), F.col("_top"))).drop("_top")
    df = df.withColumn("_on", F.when(F.col("_price") >= F.col("_peak"), F.col("_at")))
    df = carried(df, F.max("_on"), F.max("_end"), "_last")
    df = df.withColumn("_g", F.coalesce(F.last("_on", True).over(before), F.col("_last")))
    below = F.col("_on").isNull()
    low = F.min(F.when(below, F.struct(F.col("_price").alias("price"), F.col("_at").alias("at"))))
    episodes = df.where("_g is not null").groupBy(*key, "_g").agg(
        F.max(F.when(below, F.col("_peak"))).alias("peak"), F.min(F.when(below, F.col("_at"))).alias("start_at"), low.alias("_low"), F.min("_on").alias("recovered_at"), F.count_if(below).alias("rows")
    )
    depth = (F.col("_low.price") / F.nullif(F.col("peak"), F.lit(0.0)) - 1) * 100
    return episodes.where("rows > 0").select(*key, F.col("_g").alias("peak_at"), "peak", "start_at", F.col("_low.at").alias("trough_at"), F.col("_low.price").alias("trough"), "recovered_at", depth.alias("depth_pct"), "rows")


# ---- structure ----


def structure(frame: DataFrame, side: int = SIDE, key: tuple[str, ...] = KEY, order: str = "t") -> DataFrame:
    """frame with the market's structure as it is known at each row: last_high and last_low (the last confirmed swing levels), state (up: higher highs and lows, down: lower ones, mixed, null before there are two of each)
    and event (break_up where the close passes the last high that the one before didn't pass, break_down, else null) and reversal (whether the break goes against the state).

    A swing counts only ``side`` rows after it, when it is seen to be the extreme of the rows around it; no value reads a later row. One sort by series serves all windows."""
    w = Window.partitionBy(*key).orderBy(order)
    around, upto = w.rowsBetween(-2 * side, 0), w.rowsBetween(Window.unboundedPreceding, 0)
    whole = F.count("*").over(around) == 2 * side + 1
    df = frame.withColumns({"_high": F.when(whole & (F.lag("high", side).over(w) == F.max("high").over(around)), F.lag("high", side).over(w)), "_low": F.when(whole & (F.lag("low", side).over(w) == F.min("low").over(around)), F.lag("low", side).over(w))})
    prior = w.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({f"_before{c}": F.when(F.col(c).isNotNull(), F.last(c, True).over(prior)) for c in ("_high", "_low")})
    df = df.withColumns({"last_high": F.last("_high", True).over(upto), "last_low": F.last("_low", True).over(upto)} | {f"_one{c}": F.last(F.when(F.col(c).isNotNull(), F.struct(F.col(f"_before{c}").alias("x"))), True).over(upto)["x"] for c in ("_high", "_low")})
    up, down = (F.col("last_high") > F.col("_one_high")) & (F.col("last_low") > F.col("_one_low")), (F.col("last_high") < F.col("_one_high")) & (F.col("last_low") < F.col("_one_low"))
    state = F.when(F.col("_one_high").isNull() | F.col("_one_low").isNull(), F.lit(None)).when(up, "up").when(down, "down").otherwise("mixed")
    close = F.lag("close").over(w)
    event = F.when((F.col("close") > F.col("last_high")) & (close <= F.col("last_high")), "break_up").when((F.col("close") < F.col("last_low")) & (close >= F.col("last_low")), "break_down")
    df = df.withColumns({"state": state, "event": event})
    against = (F.col("event") == "break_up") & (F.col("state") == "down") | (F.col("event") == "break_down") & (F.col("state") == "up")
    return df.withColumn("reversal", F.when(F.col("event").isNotNull(), F.coalesce(against, F.lit(False)))).drop("_high", "_low", "_before_high", "_before_low", "_one_high", "_one_low")


# ---- regime of volatility ----


def ranks(x: np.ndarray, window: int, block: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """For every value how many of the ``window`` values up to it, itself included, are no greater, and how many there are; NaN counts for nothing.

    Blocks are sorted once and asked by bisection by all rows whose window covers them; the rest of a window, less than a block at each end, is compared value by value."""
    n, known = len(x), ~np.isnan(x)
    y, at = np.where(known, x, np.inf), np.arange(n)
    below, start = np.zeros(n, np.int64), np.maximum(0, at - window + 1)
    for lo in range(0, n - block + 1, block):
        rows = at[lo + block - 1 : min(n, lo + window)]
        below[rows] += np.searchsorted(np.sort(y[lo : lo + block]), y[rows], "right")
    first = -(-start // block) * block  # the first whole block of a window, and where the last one ends
    last = np.maximum(first, (at + 1) // block * block)
    whole = first + block <= at + 1
    left_end, right_start = np.where(whole, first, at + 1), np.where(whole, last, at + 1)
    for begin, end, most in ((start, left_end, 2 * block), (right_start, at + 1, block)):
        for d in range(most):
            k = begin + d
            inside = k < end
            below += inside & (y[np.minimum(k, n - 1)] <= y)
    total = np.concatenate([[0], np.cumsum(known)])
    return below, total[at + 1] - total[start]


def volatility_regime(frame: DataFrame, column: str = "atr_pct", window: int = 250, least: int = 50, low: float = 0.2, high: float = 0.8, key: tuple[str, ...] = KEY, order: str = "t") -> DataFrame:
    """key, order, ``column``, rank_pct and volatility: the share of the last ``window`` rows' values that are no greater, exactly, and low up to ``low``, high from ``high``, else normal.

    Null where the value is null or fewer than ``least`` values are in the window. ``order`` numbers the rows of a series from 1. Rows are dealt in chunks of 16 windows, each with the
    window before it, so long series are many tasks and the work is linear in rows."""
    size, fields = 16 * window, {f.name: f.dataType.simpleString() for f in frame.schema.fields}
    chunk = F.floor((F.col(order) - 1) / size)
    own = frame.select(*key, order, F.col(column).cast("double").alias("x"))
    tail = (F.col(order) - 1) % size >= size - window + 1
    dealt = own.withColumn("_c", F.explode(F.when(tail, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))))

    def run(of: tuple, df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(order, kind="stable")
        below, count = ranks(df["x"].to_numpy(float), window)
        mine = ((df[order] - 1) // size == of[-1]).to_numpy()
        share = np.where(df["x"].notna().to_numpy() & (count >= least), below / np.maximum(count, 1), np.nan)
        out = df.loc[mine, [*key, order]].copy()
        for name, values in ((column, df["x"].to_numpy(float)), ("rank_pct", share)):
            out[name] = pd.array([None if v != v else float(v) for v in values[mine]], "Float64")
        return out

    schema = ", ".join([*(f"`{k}` {fields[k]}" for k in key), f"`{order}` {fields[order]}", f"`{column}` double", "rank_pct double"])
    regime = F.when(F.col("rank_pct") <= low, "low").when(F.col("rank_pct") >= high, "high").when(F.col("rank_pct").isNotNull(), "normal")
    return dealt.groupBy(*key, "_c").applyInPandas(run, schema).withColumn("volatility", regime)
