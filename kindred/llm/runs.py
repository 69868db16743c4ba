"""Runs of values in flat arrays: gathering them, binary columns of them, and a bounded table of runs by key."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of the runs [start, start + size) one after another."""
    size = size.astype(np.int64)
    end = np.cumsum(size)
    return np.repeat(start - (end - size), size) + np.arange(end[-1] if len(end) else 0)


def bounds(sizes: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(sizes))


def binary(sizes: np.ndarray, values: np.ndarray) -> pa.Array:
    """Runs of ``sizes`` values each as a binary column."""
    ends = (bounds(sizes) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(values)])


class RunTable:
    """A memo from strings to runs in one pool. When it is full the more frequent half stays, without long
    keys, so it is bounded and only affects speed."""

    def __init__(self, dtype: str, limit: int = 500_000, long: int = 200):
        self.limit, self.long = limit, long
        self.index: dict[str, int] = {"": 0}
        self.start, self.size, self.hits = np.zeros(1, np.int64), np.zeros(1, np.int64), np.ones(1, np.int64)
        self.pool = np.zeros(0, dtype)

    def room(self) -> None:
        if len(self.index) <= self.limit and len(self.pool) <= 8 * self.limit:
            return
        keep = np.union1d(np.argsort(-self.hits, kind="stable")[: self.limit // 2], [0])
        # a hot key's run may be long, but all of them together may not
        keep = keep[np.cumsum(self.size[keep]) <= 4 * self.limit]
        place = np.full(len(self.hits), -1)
        place[keep] = np.arange(len(keep))
        place = place.tolist()
        self.index = {w: place[k] for w, k in self.index.items() if place[k] >= 0 and len(w) <= self.long}
        self.pool = self.pool[ragged(self.start[keep], self.size[keep])]
        self.size, self.hits = self.size[keep], self.hits[keep] // 2
        self.start = np.cumsum(self.size) - self.size

    def find(self, names: list[str], times: np.ndarray, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The places of distinct keys that occur so many ``times``; ``learn`` gives (sizes, values) of those not seen yet."""
        fresh = [w for w in names if w not in self.index]
        if fresh:
            size, values = learn(fresh)
            self.index.update(zip(fresh, range(len(self.size), len(self.size) + len(fresh))))
            self.start = np.append(self.start, len(self.pool) + np.cumsum(size) - size)
            self.size = np.append(self.size, size)
            self.hits = np.append(self.hits, np.zeros(len(fresh), np.int64))
            self.pool = np.append(self.pool, values)
        spot = np.fromiter(map(self.index.__getitem__, names), np.int64, len(names))
        self.hits[spot] += times
        return spot

    def gather(self, spot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, values) of the runs at these places."""
        size = self.size[spot]
        return size, self.pool[ragged(self.start[spot], size)]
