"""Indicators against pandas, and series at the edges."""

import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.functions.ewm import span, with_ew
from marketloom.operators import candles as C
from marketloom.operators import indicators as I
from marketloom.operators import levels as L
from marketloom.operators import rules as R
from marketloom.operators.candles import latest_n
from marketloom.plans import analysis as A

SCHEMA = "symbol string, timeframe string, open_time timestamp_ntz, open double, high double, low double, close double, volume double"


def series(closes, name="A", spread=0.35, volume=lambda i: 1500.0 + 3 * i):
    start, out, prev = dt.datetime(2025, 1, 1), [], closes[0]
    for i, c in enumerate(closes):
        out.append((name, "1h", start + dt.timedelta(hours=i), float(prev), max(prev, c) + spread, min(prev, c) - spread, float(c), volume(i)))
        prev = c
    return out


def trending(n, drift=0.25):
    out, prev = [], 100.0
    for i in range(n):
        prev = max(1.0, prev + drift + (i % 12 - 6) * 0.04)
        out.append(round(prev, 6))
    return out


def wave(n):
    return [round(100 + 5 * ((i * 7) % 11 - 5) / 5 + (i % 3), 4) for i in range(n)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(series(wave(150)) + series(trending(300), "B"), SCHEMA)


def test_against_pandas(spark, frame):
    got = I.indicators(C.series_frame(frame)).where("symbol = 'A'").orderBy("t").toPandas()
    p = got[["high", "low", "close"]].copy()
    ew = lambda x, n: x.ewm(span=n, adjust=False).mean()
    wilder = lambda x: x.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    d = p.close.diff()
    rsi = 100 - 100 / (1 + wilder(d.clip(lower=0)) / wilder(-d.clip(upper=0)))
    tr = pd.concat([p.high - p.low, (p.high - p.close.shift()).abs(), (p.low - p.close.shift()).abs()], axis=1).max(axis=1)
    up, down = p.high.diff(), -p.low.diff()
    plus, minus = up.where((up > down) & (up > 0), 0.0), down.where((down > up) & (down > 0), 0.0)
    pdi, mdi = 100 * wilder(plus) / wilder(tr), 100 * wilder(minus) / wilder(tr)
    dx = 100 * (pdi - mdi).abs() / (pdi + mdi).replace(0, float("nan"))
    macd = ew(p.close, 12) - ew(p.close, 26)
    for name, want in {"ema_20": ew(p.close, 20), "ema_200": ew(p.close, 200), "rsi_14": rsi, "atr_14": wilder(tr), "adx_14": wilder(dx), "macd_signal": ew(macd, 9), "sma_20": p.close.rolling(20).mean(), "bb_upper": p.close.rolling(20).mean() + 2 * p.close.rolling(20).std(ddof=0)}.items():
        pd.testing.assert_series_equal(got[name], want, check_names=False, rtol=1e-9)


def test_gaps_in_a_mean(spark):
    from marketloom.functions.ewm import with_ew

    x = [1.0, 3.0, None, None, 5.0, 4.0, None, 8.0]
    df = spark.createDataFrame([("A", "1h", t + 1, v) for t, v in enumerate(x)], "symbol string, timeframe string, t int, x double")
    got = with_ew(df, {"y": ("x", 0.3, 2)}).orderBy("t").toPandas().y
    pd.testing.assert_series_equal(got, pd.Series(x).ewm(alpha=0.3, adjust=False, min_periods=2).mean(), check_names=False, rtol=1e-12)


def test_long_series(spark):
    """Every row of a series of 7,000, with values over all its history, and a gap longer than a segment in a mean."""
    rng = np.random.default_rng(3)
    df = pd.DataFrame(series((100 + rng.normal(0, 1, 7000).cumsum() / 20).tolist()), columns=[c.split()[0] for c in SCHEMA.split(", ")])
    rows = I.macd(I.emas(C.series_frame(spark.createDataFrame(df, SCHEMA)))).orderBy("t").toPandas()
    ema = lambda s, n: s.ewm(span=n, adjust=False).mean()
    line = ema(df.close, 12) - ema(df.close, 26)
    assert len(rows) == 7000
    for got, want in [(f"ema_{n}", ema(df.close, n)) for n in (20, 50, 200)] + [("macd_line", line), ("macd_signal", ema(line, 9))]:
        assert np.allclose(rows[got], want, rtol=1e-9, atol=1e-9), got
    x = df.close.where((df.index < 100) | (df.index > 5500) & (df.index % 3 != 0))
    gaps = spark.createDataFrame([("A", "1h", i + 1, None if pd.isna(v) else float(v)) for i, v in enumerate(x)], "symbol string, timeframe string, t long, x double")
    got = with_ew(gaps, {"m": ("x", span(9), 1), "w": ("x", span(200), 14)}).orderBy("t").toPandas()
    assert np.allclose(got.m, ema(x, 9), rtol=1e-9)
    assert np.allclose(got.w, x.ewm(span=200, adjust=False, min_periods=14).mean(), rtol=1e-9, equal_nan=True)


def test_document(spark, frame):
    row = A.document(A.analyze(frame)).where("symbol = 'B'").first()
    said = json.loads(row.document)
    assert said["open_time"].endswith("Z") and said["regime"]["label"] == "bull_trend" and said["n"] == 300 and len(said["resistances"]) <= 5
    with pytest.raises(ValueError):
        A.analyze(frame, 59)


def test_trend(spark, frame):
    row = A.analyze(frame).where("symbol = 'B'").first()
    assert row.regime.label == "bull_trend" and row.regime.confidence >= 0.55
    assert row.ema_20 > row.ema_50 > row.ema_200
    assert row.rsi_14 is None or row.rsi_14 > 50


@pytest.mark.parametrize(("closes", "label", "rsi"), [([100.0] * 80, "transition", None), ([100.0 + i for i in range(80)], None, None), ([200.0 - i for i in range(80)], None, 0.0)])
def test_flat_rising_falling(spark, closes, label, rsi):
    row = A.analyze(spark.createDataFrame(series(closes, spread=0.0), SCHEMA)).first()
    assert label is None or row.regime.label == label
    assert row.rsi_14 == rsi


def test_short_and_empty(spark):
    df = spark.createDataFrame(series(wave(59)) + series(wave(60), "B"), SCHEMA)
    assert [r.symbol for r in A.analyze(df).collect()] == ["B"]
    assert [(r.symbol, r.n) for r in A.rejected(df).collect()] == [("A", 59)]
    assert A.analyze(df.limit(0)).count() == 0


def test_missing_volume_and_two_providers(spark):
    df = spark.createDataFrame(series(wave(70), volume=lambda i: None), SCHEMA)
    both = df.withColumn("provider_code", F.lit("b")).union(df.withColumn("provider_code", F.lit("a")))
    assert C.series_frame(both).where("volume <> 0").count() == 0
    assert latest_n(both, 10).count() == 10


def test_tied_swings_and_clusters(spark):
    df = C.series_frame(spark.createDataFrame(series([10.0, 11, 12, 13, 13, 12, 11, 10, 9], spread=0.0), SCHEMA))
    assert L.swings(df).where("swing_high is not null").count() == 3  # a close is the next row's open
    got = spark.range(1).select(L.clusters(F.array(*(F.lit(x) for x in (100.0, 100.3, 100.45, 101.0)))).alias("c")).first().c
    assert [(round(x.price, 4), x.touches) for x in got] == [(100.25, 3), (101.0, 1)]


def test_breakout_and_reversion(spark):
    row = dict(close=103.2, prev_close=100.0, volume=1400.0, volume_sma_20=900.0, adx_14=31.0, rsi_14=31.0, bb_lower=98.3, bb_upper=110.0, bb_middle=101.0)
    df = spark.createDataFrame([row])
    s = df.select(R.breakout(F.lit(98.5), F.lit(102.5)).alias("s")).first().s
    assert (s.direction, s.score, s.stop_hint) == ("bullish", 81.0, 102.5)
    assert df.select(R.breakout(F.lit(None).cast("double"), F.lit(None).cast("double")).alias("s")).first().s is None
    s = df.withColumn("close", F.lit(97.9)).withColumn("adx_14", F.lit(17.0)).select(R.mean_reversion(F.lit("range")).alias("s")).first().s
    assert s.direction == "bullish" and abs(s.score - 57.8) < 1e-9


def test_segments_and_groups_are_carried(spark, monkeypatch):
    """With short segments and groups of them, gaps and late starts, each row has what a plain loop gives; many groups are passed."""
    import random

    from marketloom.functions import ewm

    monkeypatch.setattr(ewm, "SEGMENT", 5)
    monkeypatch.setattr(ewm, "FAN", 3)
    rng = random.Random(2)
    rows = [("A", "1h", t, None if t < 20 or rng.random() < 0.3 or 100 < t < 140 else rng.random()) for t in range(1, 301)] + [("B", "1h", t, 1.0 * t) for t in range(1, 46)]
    means = {"e": ("x", 0.05, 1), "w": ("x", 0.3, 4)}
    got = {(r.symbol, r.t): (r.e, r.w) for r in ewm.with_ew(spark.createDataFrame(rows, "symbol string, timeframe string, t int, x double"), means).collect()}
    for symbol in "AB":
        for k, (_, a, least) in enumerate(means.values()):
            y, n, gap = None, 0, 0
            for s, _, t, x in rows:
                if s == symbol:
                    if x is None:
                        gap += 1
                    else:
                        w = (1 - a) ** (gap + 1)
                        y, n, gap = x if y is None else (w * y + a * x) / (w + a), n + 1, 0
                    assert (got[s, t][k] is None) == (n < least) and (n < least or abs(got[s, t][k] - y) < 1e-9)
