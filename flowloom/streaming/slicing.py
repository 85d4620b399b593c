"""Progressive queries: time slices of fixed width, or of a width that a cost model fits to a latency budget."""

from __future__ import annotations

import time
from collections.abc import Iterator
from datetime import datetime, timedelta
from statistics import NormalDist

MAX_MS = 2147483647
ALPHA, TINY = 1e-5, 1e-9


def regression(history: list[tuple[float, float, float]]) -> tuple[float, float]:
    """Degree-1 fit of actual ms by range: (intercept, slope); the last ratio where either isn't positive."""
    n = len(history)
    mx, my = sum(r for r, _, _ in history) / n, sum(a for _, _, a in history) / n
    sxx = sum((r - mx) ** 2 for r, _, _ in history)
    slope = sum((r - mx) * (a - my) for r, _, a in history) / sxx if sxx else 0.0
    intercept = my - slope * mx
    if intercept <= TINY or slope <= TINY:
        return TINY, history[-1][2] / history[-1][0]
    return intercept, slope


def variance(history: list[tuple[float, float, float]], a0: float, a1: float) -> float:
    """Mean squared residual of the fit for up to three observations, else mean squared error of real estimates."""
    if len(history) <= 3:
        return sum((a0 + a1 * r - a) ** 2 for r, _, a in history) / len(history)
    real = [(e, a) for _, e, a in history if e != MAX_MS]
    return sum((e - a) ** 2 for e, a in real) / len(real) if real else 0.0


class Drum:
    """Estimates the width (hours) of the next slice from (range, estimate, actual ms) of the slices before."""

    def __init__(self, total_hours: float, min_hours: float, alpha: float = ALPHA):
        self.total, self.least, self.alpha = total_hours, min_hours, alpha
        self.history: list[tuple[float, float, float]] = []

    def learn(self, hours: float, estimate: float, actual: float) -> None:
        self.history.append((hours, estimate, max(actual, TINY)))

    def estimate(self, limit: float) -> tuple[int, int]:
        """(hours, expected ms); the expectation is MAX_MS while there is no fit."""
        h = self.history
        if not h:
            return int(self.least), MAX_MS
        if len(h) < 3:
            return self.valid(h[-1][0] * limit / h[-1][2]), MAX_MS
        a0, a1 = regression(h)
        hours = self.valid(self.optimum(limit, a0, a1, variance(h, a0, a1)))
        return hours, int(a0 + a1 * hours)

    def optimum(self, limit: float, a0: float, a1: float, var: float) -> float:
        z = 2 * limit / (a1 * self.total * self.alpha) - 1
        if z <= -1:
            return 0.0
        if z > 0:
            return (limit - a0) / a1
        inverse_erf = NormalDist().inv_cdf((z + 1) / 2) / 2**0.5
        return (limit - a0 + (2 * var) ** 0.5 * inverse_erf) / a1

    def valid(self, hours: float) -> int:
        """At least the minimum and at most twice the last width."""
        last = self.history[-1][0]
        return int(-(-max(self.least, min(int(hours), 2 * last)) // 1))


def fixed_slices(first: datetime, last: datetime, days: int) -> Iterator[tuple[datetime, datetime, bool]]:
    """(start, end, done) forward from the first date; the last slice ends at the last date."""
    start = first
    while True:
        end = min(start + timedelta(days=days), last)
        yield start, end, end >= last
        if end >= last:
            return
        start = end


def drum_slices(first: datetime, last: datetime, run, interval_ms: float = 500, initial_days: float = 2, minimum_days: float = 1, clock=time.perf_counter) -> Iterator[tuple]:
    """(result of run(start, end), start, end, done), backward from the newest; what a slice leaves of its budget goes to the next."""
    drum = Drum((last - first) // timedelta(hours=1), minimum_days * 24)
    limit, estimate, hours, end = interval_ms, MAX_MS, initial_days * 24, last
    while True:
        start = max(first, end - timedelta(hours=hours))
        began = clock()
        result = run(start, end)
        spent = (clock() - began) * 1000
        drum.learn((end - start) / timedelta(hours=1), estimate, spent)
        yield result, start, end, start <= first
        if start <= first:
            return
        limit = interval_ms + max(0.0, limit - spent)
        hours, estimate = drum.estimate(limit)
        end = start


def progressive(source, first, last, run, config, fixed: bool = False):
    """Batches of weighted edges with their slice: (edges, start, end, done). `run(df)` is what a slice costs, e.g. a count."""
    from flowloom.operators.edges import between, weighted
    from flowloom.operators.store import settle

    def one(start, end):
        batch = settle(weighted(between(source, start, end, first=start <= first), config.least_length2))
        run(batch)
        return batch

    if fixed:
        for start, end, done in fixed_slices(first, last, config.fixed_days):
            yield one(start, end), start, end, done
    else:
        yield from drum_slices(first, last, one, config.interval_ms, config.initial_days, config.minimum_days)
