"""Counting 64-bit codes inside tasks, and bounding what a model keeps of the counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Codes that a task holds before it sorts and sums them; and different ones before it hands them on.
HELD, MOST = 2 << 20, 8 << 20


class Counter:
    """Sums how often each code comes, as (code, n); what one task hands on in parts is summed again by the shuffle."""

    def __init__(self, held: int = HELD, most: int = MOST) -> None:
        self.limit, self.most = held, most
        self.clear()

    def clear(self) -> None:
        self.held, self.n, self.codes, self.counts = [], 0, np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, codes: np.ndarray, counts: np.ndarray | None = None) -> None:
        self.held.append((codes.view(np.int64), np.ones(len(codes), np.int64) if counts is None else counts))
        self.n += len(codes)
        if self.n >= self.limit + len(self.codes):
            self.fold()

    def full(self) -> bool:
        return len(self.codes) >= self.most

    def fold(self) -> None:
        parts = [(self.codes, self.counts), *self.held]
        codes, counts = (np.concatenate(x) for x in zip(*parts))
        self.held, self.n = [], 0
        if len(codes):
            order = np.argsort(codes, kind="stable")
            codes, counts = codes[order], counts[order]
            first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            codes, counts = codes[first], np.add.reduceat(counts, first)
        self.codes, self.counts = codes, counts

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        self.fold()
        return self.codes, self.counts

    def batches(self, size: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What was counted, in parts; then it counts anew."""
        codes, counts = self.result()
        self.clear()
        for lo in range(0, len(codes), size):
            yield codes[lo : lo + size], counts[lo : lo + size]


def bounded(counts: DataFrame, max_rows: int, col: str = "n") -> DataFrame:
    """The rows of the highest counts, at most max_rows, for tasks to hold: all, or those of at least the count that lets them
    fit. What is left out has to be looked up in another way, so that the bound never changes a result."""
    sizes = counts.groupBy(F.least(F.col(col), F.lit(1 << 20)).alias("c")).count().orderBy("c").collect()
    total, least = sum(r["count"] for r in sizes), 1
    for r in sizes:
        if total <= max_rows:
            break
        total, least = total - r["count"], r["c"] + 1
    return counts if least <= 1 else counts.filter(F.col(col) >= least)
