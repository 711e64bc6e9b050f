"""Timers that nest, and statistics of operations."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager


class Timers:
    """Wall seconds and calls by path of nested names."""

    def __init__(self, clock=time.perf_counter):
        self.clock, self.path, self.seconds, self.calls = clock, [], {}, {}

    @contextmanager
    def timed(self, name: str) -> Iterator[None]:
        self.path.append(name)
        key, start = "/".join(self.path), self.clock()
        try:
            yield
        finally:
            self.seconds[key] = self.seconds.get(key, 0.0) + self.clock() - start
            self.calls[key] = self.calls.get(key, 0) + 1
            self.path.pop()

    def table(self) -> list[tuple[str, int, float, float]]:
        """path, calls, seconds, and seconds not spent in timers below."""
        own = dict(self.seconds)
        for key, s in self.seconds.items():
            if "/" in key:
                own[key.rsplit("/", 1)[0]] -= s
        return [(k, self.calls[k], self.seconds[k], own[k]) for k in sorted(self.seconds)]


class Statistics:
    """Count, sum, least and largest of what operations report (seconds, rows, bytes), and rates of them."""

    def __init__(self):
        self.rows: dict[str, list[float]] = {}

    def add(self, name: str, value: float) -> None:
        n, total, least, most = self.rows.get(name, [0, 0.0, float("inf"), float("-inf")])
        self.rows[name] = [n + 1, total + value, min(least, value), max(most, value)]

    def rate(self, what: str, seconds: str) -> float:
        """Of `what` in a second; 0 without time."""
        spent = self.rows.get(seconds, [0, 0.0])[1]
        return self.rows.get(what, [0, 0.0])[1] / spent if spent else 0.0
