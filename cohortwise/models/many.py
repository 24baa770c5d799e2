"""Linear models for any number of cohorts: sums, solves and scores stay in groups of executors.

A fit needs the rows of a (cohort, part) only through count, means, centred products, minima and maxima; parts are the folds of
the training rows and the test rows. Rows meet by cohort, and a task sums up and solves all its cohorts at once, as arrays over cohorts,
for every candidate and left-out fold, and scores them from the same sums: an error's square needs no row. A cohort with very many rows
(``HOT_ROWS``) is folded where its rows lie instead: partial sums of a part merge pairwise by the usual update of centred moments (Chan,
Golub, LeVeque, 1983), so no shift has to be known before, and it arrives as few packed rows. Nothing grows with the number of cohorts on
the driver or in a closure.

Defined cases: rows with a missing feature or label, NaN included, are left out; parts without rows have no score (NULL); a cohort
without training rows has no fit. NULL cohorts are left out. A constant label has no R2. Too few rows for a unique least-squares
solution give the shortest one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.bounded import collect_bounded, discard, materialize, narrow_batches
from cohortwise.functions.columns import nan_to_null
from cohortwise.models.linear import FINAL, CohortSums, LinearSpec, _lasso, _Sums
from cohortwise.operators.batches import Moments, matrix

TEST = -2
#: Parts of which a task holds sums before it hands them on.
HELD_PARTS = 20_000
#: Rows of sums that one group takes; a group holds many cohorts, and a part has a row per task at most.
GROUP_ROWS = 20_000
#: Rows that meet in one task, and rows of a cohort from which it is folded where its rows lie; most of such cohorts, and counters that find them.
TASK_ROWS, HOT_ROWS, HOT_COHORTS, COUNTERS = 500_000, 100_000, 2048, 65_536
PARTIAL = "cohort string, part int, n double, mean array<double>, spread array<double>, low array<double>, high array<double>"
_NAMES = [c.strip().split(" ")[0] for c in PARTIAL.split(", ")]
FITS = ("cohort string, model string, left_out int, n bigint, intercept double, coefficients array<double>, "
        "train_rmse double, train_r2 double, held_n bigint, held_rmse double, held_r2 double")
_FITS_ARROW = pa.schema([(name, {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}[kind])
                         for name, kind in (c.strip().split(" ") for c in FITS.split(", "))])


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[tuple[str, int], Moments] = {}
    flush = lambda: pd.DataFrame([(c, p, *m.row()) for (c, p), m in held.items()], columns=_NAMES)
    for batch in batches:
        batch = batch.dropna(subset=["part"]).astype({"part": "int32"})
        values = batch.iloc[:, 2:].to_numpy(dtype="float64")
        for key, at in batch.groupby(["cohort", "part"], sort=False).indices.items():
            found = Moments.of(values[at])
            held[key] = held[key] + found if key in held else found
        if len(held) > HELD_PARTS:
            yield flush()
            held = {}
    if held:
        yield flush()


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    held: dict[tuple[str, int], Moments] = {}
    for r in rows.itertuples(index=False):
        key, found = (r.cohort, r.part), Moments.read(r)
        held[key] = held[key] + found if key in held else found
    return pd.DataFrame([(c, p, *m.row()) for (c, p), m in held.items()], columns=_NAMES)


def _dealt(sums: DataFrame, rows: int, *keys: str):
    """Groups of about ``GROUP_ROWS`` rows with equal ``keys`` together."""
    return sums.groupBy(F.pmod(F.xxhash64(*keys), F.lit(-(-max(rows, 1) // GROUP_ROWS))).alias("group"))


def _placed(df: DataFrame, target: str, features: Sequence[str], cohort: str) -> DataFrame:
    """(cohort, part, features..., label); rows without part do not count. They are left to the tasks: a filter would compute the split once more."""
    part = F.when(F.col("split") == "train", F.coalesce(F.col("fold").cast("int"), F.lit(FINAL))).when(F.col("split") == "test", F.lit(TEST))
    columns = [nan_to_null(F.col(c).cast("double")).alias(f"v{k}") for k, c in enumerate([*features, target])]
    rows = df.where(F.col(cohort).isNotNull()).select(F.col(cohort).cast("string").alias("cohort"), part.alias("part"), *columns)
    return rows.dropna(subset=[f"v{k}" for k in range(len(columns))])


def part_moments(df: DataFrame, target: str, features: Sequence[str], cohort: str) -> DataFrame:
    """One ``PARTIAL`` row per cohort and part."""
    return _moments(_placed(df, target, features, cohort))


def _moments(rows: DataFrame) -> DataFrame:
    with narrow_batches(rows):
        partial = materialize(rows.mapInPandas(_fold, PARTIAL), "partial-moments")
    merged = materialize(_dealt(partial, partial.count(), "cohort", "part").applyInPandas(_merge, PARTIAL), "moments")
    discard(partial)
    return merged


def _as_sums(parts: dict[int, Moments]) -> CohortSums:
    """Training parts in the units that the solver takes."""
    total = None
    for m in parts.values():
        total = m if total is None else total + m
    deviation = np.sqrt(np.diag(total.spread) / total.n)
    scale = np.where(deviation > 0, deviation, 1.0)
    shifted = {}
    for part, m in parts.items():
        at = (m.mean - total.mean) / scale
        shifted[part] = _Sums(m.n, m.n * at, m.spread / np.outer(scale, scale) + m.n * np.outer(at, at), m.low, m.high)
    return CohortSums(tuple(range(len(scale))), total.mean, scale, shifted)


# --- all cohorts of a task at once --------------------------------------------

class _Stack:
    """``Moments`` of many parts: the leading axis is the part. A part without rows has count 0 and an open range."""

    def __init__(self, n: np.ndarray, mean: np.ndarray, spread: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.n, self.mean, self.spread, self.low, self.high = n, mean, spread, low, high

    @classmethod
    def empty(cls, count: int, width: int) -> "_Stack":
        return cls(np.zeros(count), np.zeros((count, width)), np.zeros((count, width, width)), np.full((count, width), np.inf), np.full((count, width), -np.inf))

    @classmethod
    def of(cls, values: np.ndarray, starts: np.ndarray) -> "_Stack":
        """Parts of consecutive rows that begin at ``starts``."""
        n = np.diff(starts, append=len(values))
        low, high = np.minimum.reduceat(values, starts), np.maximum.reduceat(values, starts)
        mean = np.where(low == high, low, np.add.reduceat(values, starts) / n[:, None])  # a constant deviates by exactly nothing
        away = values - np.repeat(mean, n, axis=0)
        width = values.shape[1]
        spread = np.empty((len(n), width, width))
        for i in range(width):
            for j in range(i, width):
                spread[:, i, j] = spread[:, j, i] = np.add.reduceat(away[:, i] * away[:, j], starts)
        return cls(n.astype(float), mean, spread, low, high)

    @classmethod
    def read(cls, rows: Sequence[Moments]) -> "_Stack":
        return cls(*(np.array([getattr(m, name) for m in rows], dtype=float) for name in ("n", "mean", "spread", "low", "high")))

    def __getitem__(self, at: np.ndarray) -> "_Stack":
        return _Stack(self.n[at], self.mean[at], self.spread[at], self.low[at], self.high[at])

    def __add__(self, other: "_Stack") -> "_Stack":
        n = self.n + other.n
        share = np.divide(other.n, n, out=np.zeros_like(n), where=n > 0)
        gap = np.where((self.n > 0)[:, None], other.mean - self.mean, other.mean)  # the first rows bring their mean as it is
        mean = np.where((other.n > 0)[:, None], self.mean + gap * np.where(self.n > 0, share, 1.0)[:, None], self.mean)
        return _Stack(n, mean, self.spread + other.spread + gap[:, :, None] * gap[:, None, :] * (self.n * share)[:, None, None],
                      np.minimum(self.low, other.low), np.maximum(self.high, other.high))

    def errors(self, intercept: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """RMSE and R2 of a formula for each part, as ``Moments.errors``; NaN stands for none."""
        direction = np.concatenate([-weights, np.ones((len(weights), 1))], axis=1)
        bias = (self.mean * direction).sum(axis=1) - intercept
        square = np.maximum(0.0, np.einsum("gi,gij,gj->g", direction, self.spread, direction) + self.n * bias * bias)
        around = self.spread[:, -1, -1]
        none = np.full(len(self.n), np.nan)
        rmse = np.sqrt(np.divide(square, self.n, out=none.copy(), where=self.n > 0))
        known = (self.n > 0) & (around > 1e-12 * np.maximum(1.0, self.n * self.mean[:, -1] ** 2))
        return rmse, np.where(known, 1 - np.divide(square, around, out=none, where=known), np.nan)


def _solutions(learned: _Stack, spec: LinearSpec) -> tuple[np.ndarray, np.ndarray]:
    """Intercepts and coefficients of one candidate for each of the learned parts; the label is the last column."""
    gram, moment = learned.spread[:, :-1, :-1], learned.spread[:, :-1, -1]
    variance = np.diagonal(gram, axis1=1, axis2=2)
    if spec.scaler == "minmax":
        size = learned.high[:, :-1] - learned.low[:, :-1]
    elif spec.scaler == "standard":
        size = np.sqrt(variance / learned.n[:, None])
    else:
        size = np.ones_like(variance)
    size = np.where((size > 0) & np.isfinite(size), size, 1.0)
    gram, moment = gram / (size[:, :, None] * size[:, None, :]), moment / size
    if spec.kind == "lasso":
        scaled = np.array([_lasso(g / n, m / n, spec.alpha, spec.max_iter, spec.tol) for g, m, n in zip(gram, moment, learned.n)]).reshape(moment.shape)
    else:
        scaled = _ridges(gram, moment, spec.alpha if spec.kind == "ridge" else 0.0)
    weights = scaled / size
    return learned.mean[:, -1] - (weights * learned.mean[:, :-1]).sum(axis=1), weights


def _ridges(gram: np.ndarray, moment: np.ndarray, alpha: float) -> np.ndarray:
    """``linear._ridge`` for stacks: (G + alpha I) w = m on unit diagonals; without a penalty the shortest exact solution."""
    d = np.sqrt(np.diagonal(gram, axis1=1, axis2=2))
    d = np.where(d > 0, d, 1.0)
    unit, right, width = gram / (d[:, :, None] * d[:, None, :]), moment / d, gram.shape[1]
    if alpha > 0:
        unit = unit + np.eye(width) * (alpha / d ** 2)[:, None, :]
        return np.linalg.solve(unit, right[:, :, None])[:, :, 0] / d
    out = np.empty_like(right)
    # The largest eigenvalue is at most the width, so a determinant away from 0 keeps the smallest one above every limit.
    plain = np.abs(np.linalg.det(unit)) > 1e-6 if width <= 8 else np.zeros(len(unit), bool)
    out[plain] = np.linalg.solve(unit[plain], right[plain][:, :, None])[:, :, 0]
    for k in np.flatnonzero(~plain):
        out[k] = np.linalg.lstsq(unit[k], right[k], rcond=1e-11)[0]
    return out / d


def _fits(names: pa.Array, group: np.ndarray, part: np.ndarray, sums: _Stack, specs: Sequence[LinearSpec], folds: bool) -> Iterator[pa.RecordBatch]:
    """``FITS`` rows of the cohorts ``names``; ``sums`` has one entry for each (group, part)."""
    count, width = len(names), sums.mean.shape[1]
    kinds = np.unique(part).tolist()
    whole = {}
    for p in kinds:
        mine = part == p
        whole[p] = full = _Stack.empty(count, width)
        for name in ("n", "mean", "spread", "low", "high"):
            getattr(full, name)[group[mine]] = getattr(sums[mine], name)
    train = [p for p in kinds if p != TEST]
    none = _Stack.empty(count, width)
    for left_out in [FINAL, *([p for p in train if p >= 0] if folds else [])]:
        learned = none
        for p in train:
            if left_out == FINAL or p != left_out:
                learned = learned + whole[p]
        fitted = learned.n > 0 if left_out == FINAL else (learned.n > 0) & (whole[left_out].n > 0)
        at = np.flatnonzero(fitted)
        if not len(at):
            continue
        held = whole.get(TEST if left_out == FINAL else left_out, none)
        if len(at) < count:
            learned, held = learned[at], held[at]
        for spec in specs:
            intercept, weights = _solutions(learned, spec)
            scores = [pa.array(x, pa.float64(), from_pandas=True) for x in (*learned.errors(intercept, weights), *held.errors(intercept, weights))]
            offsets = pa.array(np.arange(len(at) + 1, dtype=np.int32) * weights.shape[1])
            yield pa.RecordBatch.from_arrays([
                names.take(pa.array(at)), pa.array([spec.name]).take(pa.array(np.zeros(len(at), np.int32))), pa.array(np.full(len(at), left_out, np.int32)),
                pa.array(learned.n.astype(np.int64)), pa.array(intercept, from_pandas=True), pa.ListArray.from_arrays(offsets, pa.array(weights.ravel())),
                *scores[:2], pa.array(held.n.astype(np.int64)), *scores[2:]], schema=_FITS_ARROW)


def _whole_solver(specs: Sequence[LinearSpec], folds: bool):
    """All rows of the cohorts of a task to their fits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in (b.filter(b.column(1).is_valid()) if b.column(1).null_count else b for b in batches) if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        cohort = rows.column(0).chunk(0).dictionary_encode()
        code, part = cohort.indices.to_numpy().astype(np.int64), rows.column(1).to_numpy().astype(np.int64)
        key = code * (int(part.max()) - TEST + 1) + part - TEST
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.diff(key[order], prepend=-1))
        first = order[starts]
        values = matrix(rows.to_batches()[0], 2)[order]
        yield from _fits(cohort.dictionary, code[first], part[first], _Stack.of(values, starts), specs, folds)
    return run


def _sums_solver(specs: Sequence[LinearSpec], folds: bool):
    """Sums of all parts of the cohorts of a group to their fits."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        code, names = pd.factorize(rows["cohort"])
        sums = _Stack.read([Moments.read(r) for r in rows.itertuples(index=False)])
        return pa.Table.from_batches(_fits(pa.array(names, pa.string()), code, rows["part"].to_numpy(), sums, specs, folds), _FITS_ARROW).to_pandas()
    return run


def _hot(df: DataFrame, cohort: str) -> tuple[int, list[str]]:
    """Number of rows, and the cohorts that hold very many of them. Rows are counted by hashes first: only heavy ones are looked at by cohort."""
    names = df.select(F.col(cohort).cast("string").alias("cohort")).where(F.col("cohort").isNotNull())
    place = F.pmod(F.xxhash64("cohort"), F.lit(COUNTERS))
    counts = names.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n"))
    found = counts.agg(F.sum("n").alias("n"), F.collect_list(F.when(F.col("n") >= HOT_ROWS, F.struct("place", "n"))).alias("heavy")).first()
    count = found.n or 0
    limit = max(HOT_ROWS, count // HOT_COHORTS)
    heavy = [r.place for r in found.heavy if r.n >= limit]
    if not heavy:
        return count, []
    hot = names.where(place.isin(heavy)).groupBy("cohort").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= limit)
    return count, sorted(r.cohort for r in collect_bounded(hot))


def fit_many(df: DataFrame, target: str, features: Sequence[str], cohort: str, specs: Sequence[LinearSpec], folds: bool = True) -> DataFrame:
    """``FITS`` rows: every candidate of every cohort on all training rows (left_out -1, held rows are the test rows) and with each
    fold left out (held rows are that fold)."""
    count, hot = _hot(df, cohort)
    rows = _placed(df, target, features, cohort)
    few = rows.where(~F.col("cohort").isin(hot)) if hot else rows
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-count // TASK_ROWS))
    met = few.repartition(tasks, "cohort")
    with narrow_batches(met):
        fits = materialize(met.mapInArrow(_whole_solver(specs, folds), FITS), "fits")
    if not hot:
        return fits
    sums = _moments(rows.where(F.col("cohort").isin(hot)))
    many = _dealt(sums, sums.count(), "cohort").applyInPandas(_sums_solver(specs, folds), FITS)
    return fits.unionByName(many)
