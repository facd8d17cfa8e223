"""Exponentially weighted means of streams, by state and timers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.ewm import FAINT, KEY

#: What state stores a stream of means needs.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def advance(x: np.ndarray, a: float, y: float, n: int, gap: int) -> tuple[np.ndarray, np.ndarray, float, int, int]:
    """The mean after every row of x and the observations so far, then the mean, observations and nulls behind the last observation at the end. NaN is null.

    y[k] = r[k] y[k-1] + (1 - r[k]) x[k] is exp(L) * (y + sum((1 - r) x exp(-L))) with L the running sum of ln r, in stretches over which L stays small."""
    seen = np.flatnonzero(~np.isnan(x))
    means, count = np.full(len(x), np.nan if n == 0 else y), np.full(len(x), n)
    if not len(seen):
        return means, count, y, n, gap + len(x)
    behind = np.diff(seen, prepend=-1 - gap).astype(float)
    w = (1 - a) ** behind
    log = np.maximum(FAINT, np.where(behind == 1, np.log1p(-a), behind * np.log1p(-a) - np.log(w + a)))
    share, values, start = np.exp(log), x[seen], 0
    if n == 0:
        log[0], share[0] = 0.0, 0.0
    out, total = np.empty(len(seen)), np.cumsum(log)
    parts = np.floor(total / -400)
    while start < len(seen):
        end = max(start + 1, int(np.searchsorted(parts, parts[start], "right")))
        level = total[start:end] - (total[start] - log[start])
        out[start:end] = np.exp(level) * ((y if n or start else 0.0) + np.cumsum((1 - share[start:end]) * values[start:end] * np.exp(-level)))
        y, start = float(out[end - 1]), end
    at = np.searchsorted(seen, np.arange(len(x)), "right")
    means[at > 0] = out[at[at > 0] - 1]
    return means, n + at, y, n + len(seen), len(x) - 1 - int(seen[-1])


class _Means(StatefulProcessor):
    def __init__(self, means: dict, key: tuple[str, ...], at: str, delay_ms: int, grace_ms: int) -> None:
        self.means, self.key, self.at, self.delay, self.grace = means, key, at, delay_ms * 1000, grace_ms * 1000
        self.inputs = sorted({x for x, _, _ in means.values()})

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at long, x array<double>")
        self.done = handle.getValueState("done", "last long, top long, timer long, y array<double>, n array<long>, gaps array<long>")

    def _state(self) -> list:
        k = len(self.means)
        return list(self.done.get()) if self.done.exists() else [None, None, None, [0.0] * k, [0] * k, [0] * k]

    def _frame(self, key: tuple, at: np.ndarray, columns: list, late: bool) -> pd.DataFrame:
        out = {k: [v] * len(at) for k, v in zip(self.key, key)} | {self.at: pd.to_datetime(at, unit="us")} | dict(zip(self.means, columns)) | {"late": [late] * len(at)}
        return pd.DataFrame(out)

    def _out(self, key: tuple, rows: list[tuple], upto: int, state: list) -> Iterator[pd.DataFrame]:
        """The held rows up to a moment, in order; the rest stays held, and a timer is set for it."""
        ready, rest = [r for r in rows if r[0] <= upto], [r for r in rows if r[0] > upto]
        last, top, timer, y, n, gaps = state
        y, n, gaps = list(y), list(n), list(gaps)
        if ready:
            ready.sort(key=lambda r: r[0])
            at, x = np.array([r[0] for r in ready]), np.array([r[1] for r in ready], dtype=float).reshape(len(ready), -1)
            columns = []
            for k, (source, a, least) in enumerate(self.means.values()):
                mean, count, y[k], n[k], gaps[k] = advance(x[:, self.inputs.index(source)], a, y[k], n[k], gaps[k])
                columns.append(np.where(count >= least, mean, np.nan))
            last = int(at[-1])
            yield self._frame(key, at, columns, False)
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = max(1, (top - self.grace) // 1000 + 1) if rest else None
        if timer is not None:
            self.handle.registerTimer(timer)
        self.held.clear()
        if rest:
            self.held.put([(t, x) for t, x in rest])
        self.done.update((last, top, timer, y, n, gaps))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, held = self._state(), [(t, list(x)) for t, x in self.held.get()] if self.held.exists() else []
        for df in rows:
            df = df[df[self.at].notna()]
            at = df[self.at].to_numpy("datetime64[us]").astype(np.int64)
            x = df[self.inputs].to_numpy(float, na_value=np.nan)
            late = np.zeros(len(at), bool) if state[0] is None else at <= state[0]
            if late.any():
                yield self._frame(key, at[late], [np.full(int(late.sum()), np.nan)] * len(self.means), True)
            held += [(int(t), [float(v) for v in r]) for t, r in zip(at[~late], x[~late])]
        if held:
            top = max(t for t, _ in held)
            state[1] = top if state[1] is None else max(top, state[1])
            yield from self._out(key, held, state[1] - self.delay, state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self._state()
        held = [(t, list(x)) for t, x in self.held.get()] if self.held.exists() else []
        state[2] = None
        if held:
            yield from self._out(key, held, timerValues.getCurrentWatermarkInMs() * 1000 + self.grace, state)

    def close(self) -> None:
        pass


def stream_means(candles: DataFrame, means: dict[str, tuple[str, float, int]], key: tuple[str, ...] = KEY, at: str = "open_time", delay_seconds: int = 3600, grace_seconds: int = 7 * 86_400) -> DataFrame:
    """key, at, a column per entry, name -> (input column, a, least number of observations), as functions.ewm.with_ew gives them over whole series, and late.

    Rows are held in a list state until they are ``delay_seconds`` older than the newest row of their series, and then come out in order of time, so rows that are late by less give the same means as
    the sorted table. A series that is silent is let go by an event-time timer, once rows of other series are so much newer. A row that is no later than what its series has put out already comes
    out with late = true and null means and changes nothing: correct it in the store and read the series again. ``grace_seconds`` is how long late rows are looked for; Spark drops older ones by the watermark,
    which lags by delay and grace. Rows without a moment are left out. Needs the RocksDB state store (STATE_STORE). at is a timestamp."""
    spark = candles.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    fields = {f.name: f.dataType.simpleString() for f in candles.schema.fields}
    schema = ", ".join([*(f"`{k}` {fields[k]}" for k in key), f"`{at}` timestamp", *(f"`{n}` double" for n in means), "late boolean"])
    processor = _Means(means, key, at, delay_seconds * 1000, grace_seconds * 1000)
    inputs = sorted({x for x, _, _ in means.values()})
    chosen = candles.select(*key, at, *inputs).withWatermark(at, f"{delay_seconds + grace_seconds} seconds")
    return chosen.groupBy(*key).transformWithStateInPandas(processor, schema, "Append", "EventTime")
