"""Calls to providers on the driver: a cache with expiry, a sliding-window limit, retries, and the three together."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Hashable
from typing import Any


class TtlCache:
    def __init__(self, clock: Callable[[], float] = time.monotonic):
        self._clock, self._lock, self._held = clock, threading.Lock(), {}

    def get(self, key: Hashable) -> Any:
        with self._lock:
            value, until = self._held.get(key, (None, -1.0))
            if until > self._clock():
                return value
            self._held.pop(key, None)
            return None

    def put(self, key: Hashable, value: Any, seconds: float) -> None:
        with self._lock:
            self._held[key] = value, self._clock() + seconds


class SlidingWindow:
    """At most ``limit`` calls of a key in ``window`` seconds. No limit at 0 or less.

    acquire() books the next free moment, which is a window after the call ``limit`` places before, and sleeps until then; nobody waits with the lock held."""

    def __init__(self, window: float = 60.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.window, self.clock, self.sleep, self.lock = window, clock, sleep, threading.Lock()
        self.booked: dict[Hashable, list[float]] = {}

    def acquire(self, key: Hashable, limit: int) -> None:
        if limit <= 0:
            return
        with self.lock:
            now, past = self.clock(), self.booked.get(key, [])
            at = max(now, past[-limit] + self.window) if len(past) >= limit else now
            self.booked[key] = [x for x in past if x > now - self.window] + [at]
        if at > now:
            self.sleep(at - now)


def retry(call: Callable[[], Any], attempts: int = 3, first_wait: float = 0.3, factor: float = 2.0, on: tuple[type[Exception], ...] = (Exception,), sleep: Callable[[float], None] = time.sleep) -> Any:
    if attempts < 1:
        raise ValueError("attempts must be 1 or more")
    for k in range(attempts):
        try:
            return call()
        except on:
            if k == attempts - 1:
                raise
            sleep(first_wait * factor**k)


class Registry:
    """Readers by provider code."""

    def __init__(self, readers: dict[str, Any]):
        self._readers = dict(readers)

    def get(self, code: str) -> Any:
        if code not in self._readers:
            raise KeyError(f"unknown provider {code}")
        return self._readers[code]

    def codes(self) -> list[str]:
        return sorted(self._readers)


class Caller:
    """The cache first; else one place in the window, then retries, then the cache is filled. Limits of 0 mean the defaults."""

    def __init__(self, cache: TtlCache, window: SlidingWindow, limit: int = 60, seconds: float = 30.0, **retries: Any):
        self.cache, self.window, self.limit, self.seconds, self.retries = cache, window, limit, seconds, retries

    def run(self, provider: str, key: Hashable, call: Callable[[], Any], limit: int = 0, seconds: float = 0.0) -> Any:
        if (kept := self.cache.get(key)) is not None:
            return kept
        self.window.acquire(provider, limit or self.limit)
        value = retry(call, **self.retries)
        self.cache.put(key, value, seconds or self.seconds)
        return value
