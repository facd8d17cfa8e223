"""Means of streams with late rows, sessions and the store, each against the same over whole tables."""

import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from marketloom.functions.ewm import with_ew
from marketloom.streaming.candles import into_store, read_store, versions
from marketloom.streaming.means import advance, stream_means
from marketloom.streaming.sessions import sessions, stream_sessions

START = dt.datetime(2025, 1, 1)
CANDLE = "symbol string, timeframe string, open_time timestamp, close double"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(-1e3, 1e3)), max_size=60), st.sampled_from([0.01, 0.2, 1 / 14, 0.9]), st.lists(st.integers(1, 20), max_size=5))
def test_advance(values, a, sizes):
    """However a series is cut in batches, each row has the mean that a plain loop gives."""
    want, y, n, gap = [], None, 0, 0
    for v in values:
        if v is None:
            gap += 1
        else:
            w = (1 - a) ** (gap + 1)
            y, n, gap = v if y is None else (w * y + a * v) / (w + a), n + 1, 0
        want.append((n, y))
    got, state, start = [], (0.0, 0, 0), 0
    for size in [*sizes, len(values) + 1]:
        part = np.array([np.nan if v is None else v for v in values[start : start + size]], float)
        means, counts, *state = advance(part, a, *state)
        got += [(int(c), None if c == 0 else float(m)) for m, c in zip(means, counts)]
        start += size
    assert [c for c, _ in got] == [c for c, _ in want]
    assert all(m is None and v is None or abs(m - v) <= 1e-9 * max(1, abs(v)) for (_, m), (_, v) in zip(got, want))


def run(spark, tmp_path, parts, schema, make):
    """Each part as a micro-batch of its own, with the same checkpoint."""
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = make(stream).writeStream.option("checkpointLocation", str(tmp_path / "cp")).format("parquet").option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination(180)
    return spark.read.parquet(str(tmp_path / "out"))


def test_means_with_late_rows(spark, tmp_path):
    """Rows that come late by less than the delay give the means of the sorted table; later ones come out as late; a silent series is let go by its timer."""
    rng, hour = random.Random(5), dt.timedelta(hours=1)
    rows = [(s, "1h", START + h * hour, None if rng.random() < 0.15 else rng.random() * 10) for s in ("A", "B") for h in range(60)]
    quiet = [("Q", "1h", START + h * hour, float(h)) for h in range(3)]
    arriving = sorted(rows + quiet, key=lambda r: r[2] + hour * rng.uniform(0, 5))  # up to five hours late
    flush = [(s, "1h", START + h * hour, 1.0) for s in ("A", "B") for h in (90, 91)]
    too_late = [("A", "1h", START + dt.timedelta(hours=10, minutes=30), 99.0)]
    means = {"e": ("close", 0.2, 1), "w": ("close", 1 / 14, 14)}
    parts = [arriving[:40], arriving[40:41], arriving[41:], flush, too_late, [("A", "1h", START + 92 * hour, 1.0)]]
    make = lambda df: stream_means(df, means, delay_seconds=6 * 3600, grace_seconds=20 * 3600 * 10)
    found = [tuple(r) for r in run(spark, tmp_path, parts, CANDLE, make).collect()]
    ordered = Window.partitionBy("symbol").orderBy("open_time")
    want = {(r.symbol, r.open_time): (r.e, r.w) for r in with_ew(spark.createDataFrame(rows + quiet + flush, CANDLE).withColumn("t", F.row_number().over(ordered)), means).collect()}
    got = {(r[0], r[2]): r[3:5] for r in found if not r[5]}
    none = lambda x: x is None or x != x
    assert len(got) == len([r for r in found if not r[5]]) and set(k for k in want if k[0] != "Q" and k[1] <= START + 60 * hour) <= set(got)
    for k, pair in got.items():
        assert all(none(a) and none(b) or abs(a - b) < 1e-9 for a, b in zip(pair, want[k])), k
    assert [(r[0], r[2], none(r[3])) for r in found if r[5]] == [("A", too_late[0][2], True)]


def test_a_silent_series_is_let_go(spark, tmp_path):
    hour = dt.timedelta(hours=1)
    parts = [[("Q", "1h", START, 1.0), ("A", "1h", START, 1.0)], [("A", "1h", START + 40 * hour, 2.0)], [("A", "1h", START + 41 * hour, 2.0)]]
    out = run(spark, tmp_path, parts, CANDLE, lambda df: stream_means(df, {"e": ("close", 0.5, 1)}, delay_seconds=3600, grace_seconds=7200))
    assert sorted((r.symbol, r.e) for r in out.where(F.col("open_time") == START).collect()) == [("A", 1.0), ("Q", 1.0)]


ITEM = "symbol string, published_at timestamp, id int, sentiment_score double"


def brute_sessions(rows, gap):
    out = []
    for key in {r[0] for r in rows}:
        last = None
        for r in sorted((r for r in rows if r[0] == key and r[1] is not None), key=lambda r: (r[1], r[2])):
            if last is None or (r[1] - last[2]).total_seconds() >= gap(key):
                last = [key, r[1], r[1], r[2], 0, 0.0]
                out.append(last)
            last[2], last[4], last[5] = r[1], last[4] + 1, last[5] + (r[3] or 0.0)
    return sorted(tuple(r) for r in out)


def shown(df):
    return sorted((r.symbol, r.first_at, r.last_at, r.first_item, r["items"], round(r.net_sentiment, 9)) for r in df.collect())


def test_sessions(spark, tmp_path):
    """Batch and stream give the same rows as a loop: ties, gaps met exactly, sessions over midnight, a hot symbol."""
    rng, day = random.Random(8), 86_400
    rows = [(rng.choice(["hot", "hot", "x"]), START + dt.timedelta(seconds=rng.choice([rng.randrange(3 * day), day, day - 300, day + 300])), k, rng.choice([None, 0.5, -0.25])) for k in range(200)]
    gap = F.when(F.col("symbol") == "x", 600).otherwise(900)
    want = [(*r[:5], round(r[5], 9)) for r in brute_sessions(rows, lambda s: 600 if s == "x" else 900)]
    df = spark.createDataFrame([*rows, ("hot", None, 999, 1.0)], ITEM)
    for seconds in (1000, day, 100 * day):
        assert shown(sessions(df, gap, seconds=seconds)) == want
    assert sessions(df.limit(0), gap).count() == 0
    ordered = sorted(rows, key=lambda r: r[1])
    parts = [ordered[:90], ordered[90:], [("end", START + dt.timedelta(days=30), 0, 0.0)], [("end", START + dt.timedelta(days=31), 0, 0.0)]]
    out = run(spark, tmp_path, parts, ITEM, lambda s: stream_sessions(s, gap, "1 hour"))
    assert shown(out.where("symbol <> 'end'")) == want


def test_store_lists_only_touched_days(spark, tmp_path):
    """Old versions go, and the folders of other days aren't looked at: one that can't be read does no harm."""
    path, schema = str(tmp_path / "s"), "symbol string, open_time timestamp, close double"
    write = into_store(path, ("symbol", "open_time"), ("close",))
    of = lambda *rows: spark.createDataFrame([("A", dt.datetime(2025, 1, d, h), c) for d, h, c in rows], schema)
    for k in range(6):
        write(of((2, 1, float(k)), (2, 2 + k, 1.0)), k)
    write(of((1, 1, 1.0)), 6)
    assert versions(spark, path, "2025-01-02") == [4, 5] and versions(spark, path, "2025-01-01") == [6] and versions(spark, path, "2025-01-03") == []
    write(of((2, 1, 5.0), (2, 7, 1.0)), 5)  # the last batch of that day again
    got = sorted((r.open_time.hour, r.close) for r in read_store(spark, path, schema, ["2025-01-02", "2025-01-09"]).collect())
    assert got == [(1, 5.0)] + [(h, 1.0) for h in range(2, 8)] and read_store(spark, path, schema).count() == 8
    (tmp_path / "s" / "day=2025-01-01" / "version=6" / "broken.parquet").write_bytes(b"no parquet")
    write(of((2, 1, 7.0)), 7)
    assert read_store(spark, path, schema, ["2025-01-02"]).where("close = 7").count() == 1
    with pytest.raises(Exception):
        read_store(spark, path, schema).count(), read_store(spark, path, schema).collect()
