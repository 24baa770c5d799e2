"""Least squares, ridge and lasso for all cohorts, folds, penalties and scalers at once.

A linear fit needs the rows only through sums of products. One aggregation by
cohort and fold gives them; leaving a fold out is a subtraction, and scaling a
column multiplies a row and a column of the matrix. So any number of penalties,
folds and scalers costs one pass for the sums, small k-by-k solves on the
driver, and one pass that scores every candidate. k is the number of selected
features, never the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import add
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.bounded import MAX_STATISTICS_ROWS, collect_bounded, discard, materialize, narrow_batches, small_frame
from cohortwise.operators.batches import Moments, grouped, matrix

SCALERS = ("minmax", "standard", "none")
_PARTIAL = "cohort string, fold int, n double, mean array<double>, spread array<double>, low array<double>, high array<double>"
_PARTIAL_ARROW = pa.schema([("cohort", pa.string()), ("fold", pa.int32()), ("n", pa.float64()),
                            *((name, pa.list_(pa.float64())) for name in ("mean", "spread", "low", "high"))])
_SCORE_NAMES = ["fit", "split", "n", "sae", "sse", "sy", "syy"]
FINAL = -1  # the fit on all training rows, as opposed to one with fold 0.. left out


@dataclass(frozen=True)
class LinearSpec:
    """One candidate: ``kind`` is ols, ridge or lasso."""

    name: str
    kind: str
    alpha: float = 0.0
    scaler: str = "minmax"
    max_iter: int = 10_000
    tol: float = 1e-4
    features: tuple[str, ...] | None = None


@dataclass(frozen=True)
class LinearFit:
    """Coefficients in the units of the unscaled features."""

    cohort: str
    spec: LinearSpec
    left_out: int
    features: tuple[str, ...]
    level: float  # mean of the target over the training rows
    intercept: float
    coefficients: np.ndarray = field(compare=False)


@dataclass
class _Sums:
    n: float
    total: np.ndarray
    cross: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def __add__(self, other: "_Sums") -> "_Sums":
        return _Sums(self.n + other.n, self.total + other.total, self.cross + other.cross,
                     np.fmin(self.low, other.low), np.fmax(self.high, other.high))


@dataclass
class CohortSums:
    """Sums of one cohort's training rows by fold, in shifted and scaled units."""

    columns: tuple[str, ...]
    shift: np.ndarray
    scale: np.ndarray
    by_fold: dict[int, _Sums]

    def without(self, fold: int) -> _Sums | None:
        parts = [s for f, s in self.by_fold.items() if f != fold]
        result = None
        for part in parts:
            result = part if result is None else result + part
        return result


def training_sums(train: DataFrame, features: Sequence[str], target: str, cohort: str) -> dict[str, CohortSums]:
    """One pass over the (imputed) training rows: tasks fold their batches into centred moments by cohort and fold."""
    columns = tuple(dict.fromkeys([*features, target]))
    def fold_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Moments] = {}
        for batch in batches:
            values = matrix(batch, 2)
            for key, rows in grouped(batch, 2):
                found = Moments.of(values[rows])
                held[key] = held[key] + found if key in held else found
        if held:
            yield _packed([(*key, *m.row()) for key, m in held.items()])

    def merge(rows: pa.Table) -> pa.Table:
        found = [SimpleNamespace(**r) for r in rows.to_pylist()]
        return pa.Table.from_batches([_packed([(found[0].cohort, found[0].fold, *reduce(add, map(Moments.read, found)).row())])])

    wide = train.where(F.col(cohort).isNotNull()).select(
        F.col(cohort).alias("cohort"), F.col("fold").cast("int").alias("fold"), *[F.col(c).cast("double").alias(f"v{k}") for k, c in enumerate(columns)])
    with narrow_batches(wide):
        partial = materialize(wide.mapInArrow(fold_rows, _PARTIAL), "partial-moments")
    parts: dict[str, dict[int, Moments]] = {}
    for r in collect_bounded(partial.groupBy("cohort", "fold").applyInArrow(merge, _PARTIAL)):
        parts.setdefault(r.cohort, {})[r.fold] = Moments.read(r)
    discard(partial)
    return {c: _cohort_sums(columns, folds) for c, folds in parts.items()}


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(zip(*rows), _PARTIAL_ARROW)], schema=_PARTIAL_ARROW)


def _cohort_sums(columns: tuple[str, ...], folds: dict[int, Moments]) -> CohortSums:
    """Sums about the cohort's means, in its deviations. Columns without finite moments count as constant."""
    total = reduce(add, folds.values())
    finite = np.isfinite(np.diag(total.spread)) & np.isfinite(total.mean)
    constant = total.low == total.high
    shift = np.where(finite, np.where(constant, total.low, total.mean), 0.0)
    deviation = np.sqrt(np.where(finite & ~constant, np.diag(total.spread), 0.0) / total.n)
    scale = np.where(deviation > 0, deviation, 1.0)
    by_fold = {}
    for fold, m in folds.items():
        at = np.where(finite, (m.mean - shift) / scale, 0.0)
        spread = np.where(np.outer(finite, finite), m.spread / np.outer(scale, scale), 0.0)
        by_fold[fold] = _Sums(m.n, m.n * at, spread + m.n * np.outer(at, at), m.low, m.high)
    return CohortSums(columns, shift, scale, by_fold)


@dataclass
class Problem:
    """Centred sums of products of scaled features, and what turns a solution back into the units of the features."""

    n: float
    gram: np.ndarray
    moment: np.ndarray
    size: np.ndarray
    level: float
    center: np.ndarray

    def unscaled(self, scaled: np.ndarray) -> tuple[float, np.ndarray]:
        """Intercept and coefficients."""
        coefficients = scaled / self.size
        return float(self.level - coefficients @ self.center), coefficients


def problem(sums: CohortSums, left_out: int, scaler: str, features: Sequence[str], target: str) -> Problem:
    """The linear problem of the rows outside one fold."""
    rows = sums.without(left_out)
    index = [sums.columns.index(f) for f in features]
    y = sums.columns.index(target)
    mean = rows.total / rows.n
    spread = rows.cross - rows.n * np.outer(mean, mean)
    unit = sums.scale[index]
    deviation = np.sqrt(np.clip(np.diag(spread)[index], 0.0, None) / rows.n) * unit
    if scaler == "minmax":
        size = rows.high[index] - rows.low[index]
    elif scaler == "standard":
        size = deviation.copy()
    else:
        size = np.ones(len(index))
    size = np.where((size > 0) & np.isfinite(size), size, 1.0)
    stretch = unit / size
    center = sums.shift + sums.scale * mean
    return Problem(rows.n, spread[np.ix_(index, index)] * np.outer(stretch, stretch), spread[index, y] * stretch * sums.scale[y],
                   size, float(center[y]), center[index])


def solve(sums: CohortSums, left_out: int, spec: LinearSpec, features: Sequence[str],
          target: str) -> tuple[float, float, np.ndarray]:
    """Target mean, intercept and coefficients of one candidate on the rows outside one fold."""
    p = problem(sums, left_out, spec.scaler, features, target)
    if spec.kind == "lasso":
        scaled = _lasso(p.gram / p.n, p.moment / p.n, spec.alpha, spec.max_iter, spec.tol)
    else:
        scaled = _ridge(p.gram, p.moment, spec.alpha if spec.kind == "ridge" else 0.0)
    return (p.level, *p.unscaled(scaled))


def _ridge(gram: np.ndarray, moment: np.ndarray, alpha: float) -> np.ndarray:
    """(G + alpha I) w = m on unit diagonal; without a penalty the shortest exact solution."""
    d = np.sqrt(np.diag(gram))
    d = np.where(d > 0, d, 1.0)
    unit = gram / np.outer(d, d) + np.diag(alpha / d ** 2)
    if alpha > 0:
        return np.linalg.solve(unit, moment / d) / d
    return np.linalg.lstsq(unit, moment / d, rcond=1e-11)[0] / d


def _lasso(gram: np.ndarray, moment: np.ndarray, alpha: float, max_iter: int, tol: float) -> np.ndarray:
    """Coordinate descent on the sums of products (Friedman, Hastie, Tibshirani, 2010)."""
    w = np.zeros(len(moment))
    gradient = moment.copy()
    diagonal = np.diag(gram)
    limit = tol * 1e-6 * max(np.max(np.abs(moment), initial=0.0), 1e-300)
    for _ in range(max_iter):
        moved = 0.0
        for j in np.flatnonzero(diagonal > 0):
            pull = gradient[j] + diagonal[j] * w[j]
            new = np.sign(pull) * max(abs(pull) - alpha, 0.0) / diagonal[j]
            step = new - w[j]
            if step:
                gradient -= gram[:, j] * step
                w[j] = new
                moved = max(moved, abs(step) * diagonal[j])
        if moved <= limit:
            break
    return w


def fit_all(sums: dict[str, CohortSums], features: dict[str, Sequence[str]], target: str,
            specs: Sequence[LinearSpec] | dict[str, Sequence[LinearSpec]], folds: bool = True) -> list[LinearFit]:
    """Every candidate of every cohort (or of the named cohorts): the final fit and,
    unless switched off, one per left-out fold."""
    fits = []
    for cohort in sorted(sums):
        table = sums[cohort]
        for spec in specs.get(cohort, ()) if isinstance(specs, dict) else specs:
            used = tuple(spec.features or features[cohort])
            for out in [FINAL, *(sorted(k for k in table.by_fold if k is not None) if folds else [])]:
                if table.without(out) is not None:
                    fits.append(LinearFit(cohort, spec, out, used, *solve(table, out, spec, used, target)))
    return fits


def score(df: DataFrame, target: str, fits: Sequence[LinearFit], cohort: str) -> DataFrame:
    """Errors of every fit in one pass: (cohort, model, scaler, stage, split, fold, n, mae, rmse, r2).

    ``final`` fits are scored on their training and on the test rows; a fit with
    a fold left out is scored on that fold (stage ``cv``). Each task multiplies
    its batches with the coefficient matrix and emits sums, one row per fit.
    """
    names = sorted({f for fit in fits for f in fit.features})
    place = {f: i for i, f in enumerate(names)}
    plan: dict[tuple, tuple] = {}
    for group in {(fit.cohort, fit.left_out) for fit in fits}:
        ids = [i for i, fit in enumerate(fits) if (fit.cohort, fit.left_out) == group]
        weights = np.zeros((len(names), len(ids)))
        for col, i in enumerate(ids):
            weights[[place[f] for f in fits[i].features], col] = fits[i].coefficients
        needed = np.flatnonzero(np.any(weights != 0, axis=1))
        plan[group] = (np.array(ids, dtype="int32"), weights[needed], needed, np.array([fits[i].intercept for i in ids]))
    # A shift common to a cohort keeps the sums of squares of y well conditioned.
    centers = {fit.cohort: fit.level for fit in fits}

    def fold_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple, np.ndarray] = {}
        for batch in batches:
            values = matrix(batch, 3)
            for (c, split, part), index in grouped(batch, 3):  # missing splits and folds count, but belong to no fold
                groups = [(c, FINAL)] + ([(c, part)] if split == "train" else [])
                for group in groups:
                    if group not in plan:
                        continue
                    ids, weights, needed, intercept = plan[group]
                    truth = values[index, 0]
                    error = values[np.ix_(index, needed + 1)] @ weights + intercept - truth[:, None]
                    level = truth - centers[c]
                    sums = np.stack([
                        np.full(len(ids), float(len(index))), np.abs(error).sum(0), (error * error).sum(0),
                        np.full(len(ids), level.sum()), np.full(len(ids), (level * level).sum())])
                    slot = (*group, split)
                    state[slot] = sums if slot not in state else state[slot] + sums
        for (c, out, split), sums in state.items():
            ids = plan[c, out][0]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([split] * len(ids), pa.string()), *(pa.array(v) for v in sums)], _SCORE_NAMES)

    schema = "fit int, split string, n double, sae double, sse double, sy double, syy double"
    rows = df.where(F.col(cohort).isin(sorted({f.cohort for f in fits}))).select(
        F.col(cohort).alias("__c"), "split", "fold", F.col(target).cast("double").alias("__y"),
        *[F.col(f).cast("double").alias(f) for f in names if f != target]) \
        .where(F.col("__y").isNotNull())
    sums = rows.mapInArrow(fold_rows, schema).groupBy("fit", "split").agg(
        *[F.sum(s).alias(s) for s in ("n", "sae", "sse", "sy", "syy")])
    with narrow_batches(rows):  # a few rows per fit, as the labels below
        sums = small_frame(df.sparkSession, collect_bounded(sums, max(MAX_STATISTICS_ROWS, 4 * len(fits))), sums.schema)
    labels = small_frame(df.sparkSession, [
        (i, fit.cohort, fit.spec.name, fit.spec.scaler, "final" if fit.left_out == FINAL else "cv", fit.left_out)
        for i, fit in enumerate(fits)
    ], f"fit int, `{cohort}` string, model string, scaler string, stage string, fold int")
    return sums.join(F.broadcast(labels), "fit").select(
        cohort, "model", "scaler", "stage", "fold", "split", F.col("n").cast("bigint").alias("n"), *metrics_from_sums())


def metrics_from_sums() -> list[Column]:
    """MAE, RMSE and R2 from additive sums; R2 is NULL for a constant target."""
    n, around = F.col("n"), F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), F.col("n"))
    return [
        F.try_divide(F.col("sae"), n).alias("mae"),
        F.sqrt(F.try_divide(F.col("sse"), n)).alias("rmse"),
        F.when(around > 1e-12 * F.col("syy"), F.lit(1.0) - F.col("sse") / around).alias("r2"),
    ]


def prediction_sql(fit: LinearFit, prefix: str = "") -> str:
    """The fitted formula as SQL text over columns whose names start with ``prefix``."""
    terms = [f"({float(w)!r}D) * `{prefix}{f}`" for f, w in zip(fit.features, fit.coefficients) if w]
    return " + ".join([f"({float(fit.intercept)!r}D)", *terms])
