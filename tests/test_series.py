"""Cascades, drawdowns, structure, volatility ranks, sketches and payloads against plain loops."""

import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from marketloom.functions import payloads as V
from marketloom.operators import candles as C
from marketloom.operators import series as S
from marketloom.operators import sketches as K

START, HOUR = dt.datetime(2025, 1, 1), dt.timedelta(hours=1)
CANDLE = "symbol string, timeframe string, open_time timestamp_ntz, open double, high double, low double, close double, volume double"


def frame(spark, closes, symbol="A", start=START):
    rows = [(symbol, "1h", start + k * HOUR, c, None if c is None else c + 1, None if c is None else c - 1, c, 1.0) for k, c in enumerate(None if c is None else float(c) for c in closes)]
    return spark.createDataFrame(rows, CANDLE)


# ---- cascade ----


def test_cascade_is_what_the_ticks_give(spark):
    rng = random.Random(1)
    ticks = spark.createDataFrame([(rng.choice("AB"), START + dt.timedelta(minutes=rng.randrange(6000)), rng.random(), k) for k in range(400)], "symbol string, ts timestamp_ntz, price double, id int")
    hourly = C.resample(ticks, "hour", "1h")
    got = S.cascade(hourly)
    daily = {tuple(r) for r in C.resample(ticks, "day", "1d").select("symbol", "open_time", "open", "high", "low", "close", "volume").collect()}
    assert {tuple(r) for r in got.where("timeframe = '1d'").select("symbol", "open_time", "open", "high", "low", "close", "volume").collect()} == daily
    again = S.cascade(got.where("timeframe = '4h'"), {"1d": S.DAY})  # from coarser ones the same
    assert {tuple(r) for r in again.select("symbol", "open_time", "open", "high", "low", "close", "volume").collect()} == daily
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Expand") == 1 and got.where("candles = 0").count() == 0 and S.cascade(hourly.limit(0)).count() == 0


def test_cascade_null_prices_and_fill(spark):
    rows = [("A", "1h", START, None, None, None, None, None), ("A", "1h", START + HOUR, 2.0, 3.0, 1.0, 2.5, 4.0), ("A", "1h", START + 13 * HOUR, 5.0, 6.0, 4.0, 5.5, 1.0), ("B", "1h", START, 1.0, 1.0, 1.0, 1.0, 1.0)]
    out = S.filled(S.cascade(spark.createDataFrame(rows, CANDLE), {"4h": 14_400}), {"4h": 14_400})
    got = sorted((r.symbol, r.open_time.hour, r.open, r.close, r.volume, r.candles, r.filled) for r in out.collect())
    assert got == [("A", 0, 2.0, 2.5, 4.0, 2, False), ("A", 4, 2.5, 2.5, 0.0, 0, True), ("A", 8, 2.5, 2.5, 0.0, 0, True), ("A", 12, 5.0, 5.5, 1.0, 1, False), ("B", 0, 1.0, 1.0, 1.0, 1, False)]
    assert S.filled(spark.createDataFrame(rows, CANDLE)).where("filled").count() == 0  # a timeframe that isn't listed


def test_trends(spark):
    df = frame(spark, [1, 2, 3, 4, 5.0]).union(frame(spark, [5, 4, 3, 2.0], "B")).union(frame(spark, [1.0, 1, 1, 1], "C")).union(frame(spark, [1.0], "D"))
    daily = frame(spark, [9.0, 8, 7, 6]).withColumn("timeframe", F.lit("1d"))
    got = {r.symbol: (r.trends, r.alignment) for r in S.trends(df.union(daily)).collect()}
    assert got == {"A": ({"1d": -1, "1h": 1}, "mixed"), "B": ({"1h": -1}, "down"), "C": ({"1h": 0}, "mixed")}


# ---- drawdowns ----


def brute_drawdowns(closes):
    out, peak, at, now = [], None, None, None
    for k, c in enumerate(closes):
        if c is None:
            continue
        if peak is None or c >= peak:
            if now:
                out.append((*now[:5], k, now[5]))
            peak, at, now = c, k, None
        elif now is None:
            now = [at, peak, k, k, c, 1]
        else:
            now = [*now[:3], k if c < now[4] else now[3], min(c, now[4]), now[5] + 1]
    return out + ([(*now[:5], None, now[5])] if now else [])


@pytest.mark.parametrize("seconds", [3 * 3600, 100 * 86_400])
def test_drawdowns(spark, seconds):
    """Open episodes, ties with the peak, flat and rising series, nulls, many stretches."""
    rng = random.Random(6)
    walks = {"R": [round(100 + sum(rng.choice([-1, 0, 1]) for _ in range(k % 17)) + k / 40, 2) for k in range(150)], "flat": [5.0] * 10, "up": [1.0, 2, 3], "down": [9.0, 8, 7, 7], "tie": [5.0, 4, 5, 4, None, 5, 6], "one": [1.0], "none": [None, None], "late": [None, 3.0, 2.0]}
    df = None
    for s, w in walks.items():
        df = frame(spark, w, s) if df is None else df.union(frame(spark, w, s))
    got = {}
    for r in S.drawdowns(df, seconds=seconds).orderBy("peak_at").collect():
        hour = lambda t: None if t is None else int((t - START) / HOUR)
        got.setdefault(r.symbol, []).append((hour(r.peak_at), r.peak, hour(r.start_at), hour(r.trough_at), r.trough, hour(r.recovered_at), r.rows))
        assert abs(r.depth_pct - (r.trough / r.peak - 1) * 100) < 1e-9
    assert got == {s: want for s, w in walks.items() if (want := brute_drawdowns(w))}
    assert S.drawdowns(df.limit(0)).count() == 0


# ---- structure ----


def test_structure_reads_no_future(spark):
    """Cut anywhere, a series has the same last row as the whole one has there."""
    rng = random.Random(4)
    walk = [100.0]
    for _ in range(119):
        walk.append(round(walk[-1] + rng.choice([-2, -1, 0, 1, 2]), 2))
    names = ["last_high", "last_low", "state", "event", "reversal"]
    whole = [tuple(r[n] for n in names) for r in S.structure(C.series_frame(frame(spark, walk))).orderBy("t").collect()]
    cuts = None
    for n in range(1, 121, 7):
        part = frame(spark, walk[:n], f"cut{n}")
        cuts = part if cuts is None else cuts.union(part)
    for r in S.structure(C.series_frame(cuts)).withColumn("n", F.max("t").over(Window.partitionBy("symbol"))).where("t = n").collect():
        assert tuple(r[n] for n in names) == whole[r.t - 1], r.symbol
    high, low = [w + 1 for w in walk], [w - 1 for w in walk]
    confirmed = [[(k, x[k - 3]) for k in range(6, 120) if x[k - 3] == best(x[k - 6 : k + 1])] for x, best in ((high, max), (low, min))]
    for t in range(120):
        last = [[v for k, v in side if k <= t][-2:] for side in confirmed]
        assert whole[t][:2] == tuple(x[-1] if x else None for x in last)
        if all(len(x) == 2 for x in last):
            (h0, h1), (l0, l1) = last
            assert whole[t][2] == ("up" if h1 > h0 and l1 > l0 else "down" if h1 < h0 and l1 < l0 else "mixed")
        else:
            assert whole[t][2] is None
    assert {w[3] for w in whole} == {None, "break_up", "break_down"} and S.structure(C.series_frame(frame(spark, [1.0, 2.0]))).where("last_high is not null").count() == 0


# ---- volatility ----


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.just(float("nan")), st.integers(0, 5).map(float)), max_size=80), st.integers(1, 30), st.integers(1, 12))
def test_ranks(values, window, block):
    x = np.array(values, float)
    below, count = S.ranks(x, window, block)
    for k in range(len(x)):
        w = x[max(0, k - window + 1) : k + 1]
        assert count[k] == (~np.isnan(w)).sum() and (np.isnan(x[k]) or below[k] == (w <= x[k]).sum())


def test_volatility_over_chunks(spark):
    rng = random.Random(3)
    rows = [(s, "1h", t, None if rng.random() < 0.1 else rng.random()) for s, n in (("A", 700), ("B", 30), (None, 60)) for t in range(1, n + 1)]
    df = spark.createDataFrame(rows, "symbol string, timeframe string, t int, atr_pct double")
    got = {(r.symbol, r.t): (r.atr_pct, r.rank_pct, r.volatility) for r in S.volatility_regime(df, window=20, least=5).collect()}
    assert len(got) == len(rows)
    for s in ("A", "B", None):
        x = [r[3] for r in rows if r[0] == s]
        for k, v in enumerate(x):
            w = [y for y in x[max(0, k - 19) : k + 1] if y is not None]
            rank = None if v is None or len(w) < 5 else sum(y <= v for y in w) / len(w)
            assert got[s, k + 1] == (v, rank, None if rank is None else "low" if rank <= 0.2 else "high" if rank >= 0.8 else "normal")
    assert S.volatility_regime(df.limit(0)).count() == 0


def test_ranks_are_linear():
    import time

    x = np.random.default_rng(0).random(400_000)
    began = time.time()
    S.ranks(x, 5000)
    assert time.time() - began < 60


# ---- sketches ----


def test_sketches(spark):
    """Bands and distinct counts of any span of stored days are within their stated bounds; days merge in any grouping."""
    rng = np.random.default_rng(5)
    n = 60_000
    rows = spark.range(n).select(F.when(F.col("id") % 3 == 0, "B").otherwise("A").alias("symbol"), F.lit("1h").alias("timeframe"), (F.lit("2025-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(F.pmod("id", F.lit(20)).cast("int"))).alias("open_time"), F.pow(F.rand(7), F.lit(3.0)).alias("x"), F.pmod("id", F.lit(9001)).alias("user")).cache()
    days = K.daily(rows, ("x",), ("user",), k=200).cache()
    assert days.count() == 40 and rng is not None
    shares = (0.01, 0.25, 0.5, 0.75, 0.99)
    for first, last in (("2025-01-01", "2025-01-20"), ("2025-01-03", "2025-01-09"), ("2025-01-05", "2025-01-05")):
        got = {r.symbol: r for r in K.bands(K.span(days, F.lit(first).cast("date"), F.lit(last).cast("date")), shares).collect()}
        inside = rows.where(F.to_date("open_time").between(first, last)).toPandas()
        for s, part in inside.groupby("symbol"):
            x = np.sort(part.x.to_numpy())
            for p, q in zip(shares, got[s].x):
                assert np.searchsorted(x, q, "left") / len(x) - K.rank_error(200) <= p <= np.searchsorted(x, q, "right") / len(x) + K.rank_error(200)
            assert got[s].n == len(x) and abs(got[s].distinct_user - part.user.nunique()) <= K.distinct_error() * part.user.nunique()
    assert K.span(days, F.lit("2026-01-01").cast("date"), F.lit("2026-01-02").cast("date")).count() == 0


def test_sketches_of_little(spark):
    nan = float("nan")
    rows = spark.createDataFrame([("A", "1h", START, 1.0, 1), ("A", "1h", START, 3.0, 1), ("A", "1h", START, nan, None), ("A", "1h", START, None, 2), ("B", "1h", START, None, None)], "symbol string, timeframe string, open_time timestamp, x double, u int")
    got = {r.symbol: (r.n, r.x, r.distinct_u) for r in K.bands(K.span(K.daily(rows, ("x",), ("u",)), F.lit("2025-01-01").cast("date"), F.lit("2025-01-01").cast("date")), (0.5, 1.0)).collect()}
    assert got == {"A": (4, [1.0, 3.0], 2), "B": (1, None, 0)}


# ---- payloads ----


def test_payloads(spark, tmp_path):
    rows = [(1, '{"a": {"b": [1, "x", null]}, "c": 1.5}'), (2, '{"a": '), (3, None), (4, "[1, 2]"), (5, '"text"'), (6, ""), (7, '{"a": {"b": "no list"}}')]
    df = V.parsed(spark.createDataFrame(rows, "id int, text string"), "text")
    out = V.at_paths(df, {"first": ("$.a.b[0]", "int"), "second": ("$.a.b[1]", "string"), "bad": ("$.a.b[1]", "int"), "c": ("$.c", "double"), "top": ("$[1]", "int")})
    got = {r.id: (r.first, r.second, r.bad, r.c, r.top) for r in out.collect()}
    assert got[1] == (1, "x", None, 1.5, None) and got[4] == (None, None, None, None, 2) and all(got[k] == (None,) * 5 for k in (2, 3, 5, 6, 7))
    assert V.damage(df, "text").first().asDict() == {"texts": 7, "missing": 1, "damaged": 2}
    df.write.parquet(str(tmp_path / "v"))
    stored = spark.read.parquet(str(tmp_path / "v"))
    assert dict(stored.dtypes)["payload"] == "variant" and V.at_paths(stored, {"c": ("$.c", "double")}).where("c = 1.5").count() == 1
    assert "DOUBLE" in df.where("id = 1").agg(V.kinds(df)).first()[0] or "DECIMAL" in df.where("id = 1").agg(V.kinds(df)).first()[0]
