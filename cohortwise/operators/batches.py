"""Folding Arrow batches in tasks: groups of rows, present values, mergeable moments."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grouped(batch: pa.RecordBatch, keys: int) -> Iterator[tuple[tuple, np.ndarray]]:
    """(key values, rows) of every group of a batch by its first ``keys`` columns; a missing key is a value."""
    group = np.zeros(batch.num_rows, dtype=np.int64)
    for k in range(keys):
        coded = batch.column(k).dictionary_encode()
        code = coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False)
        group = np.unique(group * (len(coded.dictionary) + 1) + code, return_inverse=True)[1]
    order = np.argsort(group, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(group[order])) + 1) if batch.num_rows else ():
        yield tuple(batch.column(k)[int(rows[0])].as_py() for k in range(keys)), rows


def present_values(column: pa.Array) -> tuple[np.ndarray, np.ndarray | None]:
    """Values of a column of doubles and which are not NULL (None: all)."""
    values = column.to_numpy(zero_copy_only=False)
    return values, column.is_valid().to_numpy(zero_copy_only=False) if column.null_count else None


def add_moments(held: np.ndarray | None, n: np.ndarray, total: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Counts, sums and sums of squared deviations of two disjoint parts (Chan, Golub, LeVeque, 1983)."""
    if held is None:
        return np.array([n, total, spread], dtype=float)
    a, b = held[0], np.asarray(n, dtype=float)
    with np.errstate(all="ignore"):
        apart = np.where((a > 0) & (b > 0), (total / b - held[1] / a) ** 2 * (a * b / (a + b)), 0.0)
    return np.array([a + b, held[1] + total, held[2] + spread + apart])


def pooled_moments(partial: DataFrame, keys: Sequence[str], *others: Column) -> DataFrame:
    """(keys..., n, mean, var_pop, others...) from partial ``n``, ``total`` and ``spread``."""
    summed = partial.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"),
        F.filter(F.collect_list(F.struct("n", "total", "spread")), lambda p: p["n"] > 0).alias("parts"), *others)
    mean = F.try_divide("total", "n")
    apart = lambda p: p["total"] / p["n"] - mean
    spread = F.aggregate("parts", F.lit(0.0), lambda held, p: held + p["spread"] + p["n"] * apart(p) * apart(p))
    return summed.withColumns({"mean": mean, "var_pop": F.try_divide(spread, F.col("n"))}).drop("total", "parts")


class Moments:
    """Count, means, centred products and ranges of the rows of one part."""

    def __init__(self, n: float, mean: np.ndarray, spread: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.n, self.mean, self.spread, self.low, self.high = n, mean, spread, low, high

    @classmethod
    def of(cls, rows: np.ndarray) -> "Moments":
        low, high = np.fmin.reduce(rows, axis=0), np.fmax.reduce(rows, axis=0)
        mean = np.where(low == high, low, rows.mean(axis=0))  # a constant deviates by exactly nothing
        away = rows - mean
        return cls(float(len(rows)), mean, away.T @ away, low, high)

    def __add__(self, other: "Moments") -> "Moments":
        n = self.n + other.n
        gap = other.mean - self.mean
        return Moments(n, self.mean + gap * (other.n / n), self.spread + other.spread + np.outer(gap, gap) * (self.n * other.n / n),
                       np.fmin(self.low, other.low), np.fmax(self.high, other.high))

    def row(self) -> tuple:
        return self.n, self.mean, self.spread.ravel(), self.low, self.high

    @classmethod
    def read(cls, r) -> "Moments":
        mean = np.asarray(r.mean)
        return cls(r.n, mean, np.asarray(r.spread).reshape(len(mean), len(mean)), np.asarray(r.low), np.asarray(r.high))

    def errors(self, intercept: float, weights: np.ndarray) -> tuple[float, float | None]:
        """RMSE and R2 of a formula on these rows; the label is the last column."""
        direction = np.append(-weights, 1.0)
        bias = self.mean @ direction - intercept
        square = max(0.0, float(direction @ self.spread @ direction) + self.n * bias * bias)
        around = self.spread[-1, -1]
        return float(np.sqrt(square / self.n)), 1 - square / around if around > 1e-12 * max(1.0, self.n * self.mean[-1] ** 2) else None


def matrix(batch: pa.RecordBatch, first: int) -> np.ndarray:
    """The columns of doubles from ``first`` on, one row per row; NULL is NaN."""
    out = np.empty((batch.num_rows, batch.num_columns - first))
    for k in range(first, batch.num_columns):
        out[:, k - first] = batch.column(k).to_numpy(zero_copy_only=False)
    return out
