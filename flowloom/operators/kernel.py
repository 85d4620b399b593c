"""Force-directed bundling of paths in arrays: schedule, springs, resampling. One task's kernel and the steps of the distributed one share it."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Schedule of the force-directed method: cycles, first iterations, their decay, first step, stiffness.
CYCLES, ITERATIONS, DECAY, STIFFNESS, EPS = 6, 50, 2 / 3, 0.1, 1e-6


@dataclass(frozen=True)
class Turn:
    """An iteration: parts of the cycle, inner control points, step, and into how many stretches paths are cut afterwards (0: not at all)."""

    parts: int
    inner: int
    step: float
    then: int


def schedule(step: float, cycles: int = CYCLES, iterations: int = ITERATIONS) -> Iterator[Turn]:
    """All iterations: each cycle doubles the parts, halves the step and takes two thirds of the iterations of the one before."""
    parts, inner, turns = 1, 1, float(iterations)
    for cycle in range(cycles):
        many, last = math.ceil(turns - 1e-9), cycle + 1 == cycles
        after = 2 * parts + 1
        for i in range(many):
            yield Turn(parts, inner, step, after if i + 1 == many else 0)
        if not last:
            parts, step, turns, inner = parts * 2, step / 2, turns * DECAY, after - 1


def lengths(ends: np.ndarray) -> np.ndarray:
    return np.maximum(np.sqrt(((ends[:, 2:] - ends[:, :2]) ** 2).sum(axis=1)), EPS)


def straight(ends: np.ndarray, parts: int) -> np.ndarray:
    """Segments (n, 4) as paths of `parts` equal stretches."""
    return resample(np.stack((ends[:, :2], ends[:, 2:]), axis=1).astype(float), parts)


def resample(paths: np.ndarray, parts: int) -> np.ndarray:
    """Each path (n, m, 2) as `parts` stretches of equal arc length."""
    steps = np.sqrt((np.diff(paths, axis=1) ** 2).sum(axis=2))
    along = np.concatenate((np.zeros((len(paths), 1)), np.cumsum(steps, axis=1)), axis=1)
    out = np.empty((len(paths), parts + 1, 2))
    for i, (p, s) in enumerate(zip(paths, along, strict=True)):
        want = np.linspace(0, s[-1], parts + 1)
        for axis in (0, 1):
            out[i, :, axis] = np.interp(want, s, p[:, axis])
        out[i, 0], out[i, -1] = p[0], p[-1]
    return out


def units(d: np.ndarray) -> np.ndarray:
    """Directions of the vectors; none where they are shorter than EPS."""
    size = np.sqrt((d**2).sum(axis=2, keepdims=True))
    return np.where(size > EPS, d / np.maximum(size, EPS), 0.0)


def moved(paths: np.ndarray, length: np.ndarray, pull: np.ndarray, turn: Turn) -> np.ndarray:
    """Paths after an iteration: springs along each path and what pulls its inner points; ends never move."""
    k = (STIFFNESS / (length * (turn.parts + 1)))[:, None, None]
    spring = (paths[:, :-2] + paths[:, 2:] - 2 * paths[:, 1:-1]) * k
    out = paths.copy()
    out[:, 1:-1] += turn.step * (spring + pull)
    return resample(out, turn.then) if turn.then else out


def bundle(ends: np.ndarray, pairs: np.ndarray, step: float = 0.025, cycles: int = CYCLES, iterations: int = ITERATIONS, pulled: np.ndarray | None = None, pulls: np.ndarray | None = None) -> np.ndarray:
    """Force-directed bundling. ends: (n, 4); pairs: (m, 2) of row numbers, in either direction once. Paths (n, points, 2); ends never move.

    Row pulled[i] is also drawn to the control points of the segment pulls[i] (k, 4), which stay on it.
    """
    paths, length = straight(ends, 2), lengths(ends)
    both = np.concatenate((pairs, pairs[:, ::-1])) if len(pairs) else np.zeros((0, 2), dtype=int)
    some = pulled is not None and len(pulled) > 0
    for turn in schedule(step, cycles, iterations):
        pull = np.zeros((len(paths), turn.inner, 2))
        if len(both):
            np.add.at(pull, both[:, 0], units(paths[both[:, 1], 1:-1] - paths[both[:, 0], 1:-1]))
        if some:
            np.add.at(pull, pulled, units(straight(pulls, turn.inner + 1)[:, 1:-1] - paths[pulled, 1:-1]))
        paths = moved(paths, length, pull, turn)
    return paths
