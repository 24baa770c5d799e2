"""Penalty paths: ridge and lasso over many penalties, for every cohort and with each fold left out.

One pass gives the moments of every (cohort, part) (``many.part_moments``). A path is solved from the largest penalty down, in groups of
executors that hold many (cohort, left-out fold) pairs. A lasso step starts from the solution before it and looks only at the columns
that the sequential strong rule keeps (Tibshirani and others, 2012): a column whose correlation with the residual was below twice the new
penalty less the old one is set aside. The rule can err, so every step ends with a look at the optimality condition of the columns set
aside; those that break it come back and the step goes on. Ridge solutions share one eigendecomposition.

Defined cases: those of ``many.fit_many``. Penalties are sorted downwards, repeated ones count once; a negative one is an error. Without
penalties given, each cohort has ``STEPS`` of its own, evenly spaced in the logarithm, from the least that empties its lasso down to a
``DEPTH``-th of it; a cohort whose features say nothing about the label has one penalty, 0. Ridge takes penalty 0 as least squares.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.models.linear import FINAL, CohortSums, Problem, _ridge, problem
from cohortwise.models.many import TEST, Moments, _as_sums, _dealt, part_moments

STEPS, DEPTH = 40, 1000.0
PATHS = ("cohort string, model string, step int, alpha double, left_out int, n bigint, n_active int, screened int, returned int, sweeps int, "
         "intercept double, coefficients array<double>, train_rmse double, train_r2 double, held_n bigint, held_rmse double, held_r2 double")
_NAMES = [c.strip().split(" ")[0] for c in PATHS.split(", ")]


def _descend(gram: np.ndarray, w: np.ndarray, gradient: np.ndarray, columns: np.ndarray, alpha: float, max_iter: int, limit: float) -> int:
    """Coordinate descent over ``columns``, in place; ``gradient`` is the moment less gram times w. Returns the sweeps."""
    diagonal = np.diag(gram)
    columns = columns[diagonal[columns] > 0]
    for sweep in range(1, max_iter + 1):
        moved = 0.0
        for j in columns:
            pull = gradient[j] + diagonal[j] * w[j]
            step = np.sign(pull) * max(abs(pull) - alpha, 0.0) / diagonal[j] - w[j]
            if step:
                gradient -= gram[:, j] * step
                w[j] += step
                moved = max(moved, abs(step) * diagonal[j])
        if moved <= limit:
            return sweep
    return max_iter


def lasso_path(gram: np.ndarray, moment: np.ndarray, alphas: Sequence[float], max_iter: int, tol: float) -> Iterator[tuple[np.ndarray, int, int, int]]:
    """(solution, columns set aside, columns that came back, sweeps) for each of the falling ``alphas``."""
    w, gradient = np.zeros(len(moment)), moment.copy()
    top = float(np.max(np.abs(moment), initial=0.0))
    limit, before = tol * 1e-6 * max(top, 1e-300), top
    for alpha in alphas:
        kept = (np.abs(gradient) >= 2 * alpha - max(before, alpha)) | (w != 0)
        screened, returned, sweeps = int((~kept).sum()), 0, 0
        while True:
            sweeps += _descend(gram, w, gradient, np.flatnonzero(kept), alpha, max_iter, limit)
            broken = ~kept & (np.abs(gradient) > alpha + limit)
            if not broken.any():
                break
            returned += int(broken.sum())
            kept |= broken
        before = alpha
        yield w.copy(), screened, returned, sweeps


def ridge_path(gram: np.ndarray, moment: np.ndarray, alphas: Sequence[float]) -> Iterator[tuple[np.ndarray, int, int, int]]:
    """Solutions from one eigendecomposition; a penalty of 0 takes the least-squares solution."""
    values, vectors = np.linalg.eigh(gram)
    turned, values = vectors.T @ moment, np.clip(values, 0.0, None)
    for alpha in alphas:
        yield vectors @ (turned / (values + alpha)) if alpha > 0 else _ridge(gram, moment, 0.0), 0, 0, 1


def default_penalties(whole: Problem, kind: str) -> np.ndarray:
    """Falling penalties from the least that leaves no feature in the lasso; ridge penalties act on sums, not on means."""
    top = float(np.max(np.abs(whole.moment), initial=0.0)) / (whole.n if kind == "lasso" else 1.0)
    return np.geomspace(top, top / DEPTH, STEPS) if top > 0 else np.zeros(1)


def _falling(alphas: Sequence[float]) -> list[float]:
    found = sorted({float(a) for a in alphas}, reverse=True)
    if not found or not found[-1] >= 0:
        raise ValueError("penalties must be numbers of at least 0")
    return found


def _solved(cohort: str, parts: dict[int, Moments], kind: str, left_out: int, alphas: list[float] | None, scaler: str, width: int,
            max_iter: int, tol: float) -> Iterator[tuple]:
    train = {p: m for p, m in parts.items() if p != TEST}
    used = [m for p, m in train.items() if left_out == FINAL or p != left_out]
    if not used:
        return
    sums: CohortSums = _as_sums(train)
    at = lambda out: problem(sums, out if out != FINAL else TEST, scaler, range(width), width)
    own = at(left_out)
    falling = default_penalties(at(FINAL), kind) if alphas is None else alphas
    learned = used[0]
    for m in used[1:]:
        learned = learned + m
    held = parts.get(TEST if left_out == FINAL else left_out)
    steps = lasso_path(own.gram / own.n, own.moment / own.n, falling, max_iter, tol) if kind == "lasso" else ridge_path(own.gram, own.moment, falling)
    for step, (alpha, (scaled, screened, returned, sweeps)) in enumerate(zip(falling, steps)):
        intercept, weights = own.unscaled(scaled)
        yield (cohort, kind, step, float(alpha), left_out, int(learned.n), int(np.count_nonzero(weights)), screened, returned, sweeps, intercept, weights,
               *learned.errors(intercept, weights), *((int(held.n), *held.errors(intercept, weights)) if held else (0, None, None)))


def _solver(alphas, scaler: str, width: int, max_iter: int, tol: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        parts: dict[tuple, dict[int, Moments]] = {}
        for r in rows.itertuples(index=False):
            parts.setdefault((r.cohort, r.model, int(r.left_out)), {})[int(r.part)] = Moments.read(r)
        return pd.DataFrame([row for (c, kind, out), own in parts.items() for row in _solved(c, own, kind, out, alphas, scaler, width, max_iter, tol)], columns=_NAMES)
    return run


def fit_paths(df: DataFrame, target: str, features: Sequence[str], cohort: str, kinds: Sequence[str] = ("ridge", "lasso"), alphas: Sequence[float] | None = None,
              folds: Sequence[int] = range(5), scaler: str = "minmax", max_iter: int = 10_000, tol: float = 1e-4) -> DataFrame:
    """``PATHS`` rows: every penalty of every cohort on all training rows (left_out -1, held rows are the test rows) and with each of
    ``folds`` left out (held rows are that fold)."""
    if not set(kinds) <= {"ridge", "lasso"}:
        raise ValueError("a path is of ridge or lasso")
    sums = part_moments(df, target, features, cohort)
    fits = [(kind, out) for kind in kinds for out in (FINAL, *folds)]
    grid = F.inline(F.array(*[F.struct(F.lit(kind).alias("model"), F.lit(out).alias("left_out")) for kind, out in fits]))
    return _dealt(sums.select("*", grid), sums.count() * len(fits), "cohort", "model", "left_out").applyInPandas(
        _solver(None if alphas is None else _falling(alphas), scaler, len(features), max_iter, tol), PATHS)


def path_scores(paths: DataFrame) -> DataFrame:
    """(cohort, model, step, alpha, folds, cv_rmse, cv_error, n_active, train_r2, test_rmse, test_r2): a path's held-out errors by penalty;
    ``cv_error`` is the standard error of the mean over the folds."""
    cv = F.col("left_out") >= 0
    final = lambda c: F.max(F.when(F.col("left_out") == FINAL, F.col(c)))
    held = F.when(cv, F.col("held_rmse"))
    return paths.groupBy("cohort", "model", "step", "alpha").agg(
        F.count(held).alias("folds"), F.avg(held).alias("cv_rmse"), F.try_divide(F.stddev_samp(held), F.sqrt(F.count(held))).alias("cv_error"),
        final("n_active").alias("n_active"), final("train_r2").alias("train_r2"), final("held_rmse").alias("test_rmse"), final("held_r2").alias("test_r2"))


def best_penalties(scores: DataFrame, errors: float = 0.0) -> DataFrame:
    """One row per cohort and model: the largest penalty whose error is within ``errors`` standard errors of the least one.

    Paths without a cross-validated error (no folds with rows) have no best penalty.
    """
    own = Window.partitionBy("cohort", "model")  # a path's steps, not data rows
    least = F.min(F.struct("cv_rmse", "step", F.coalesce("cv_error", F.lit(0.0)).alias("error"))).over(own)
    near = scores.where("cv_rmse IS NOT NULL").withColumn("least", least).where(F.col("cv_rmse") <= F.col("least.cv_rmse") + errors * F.col("least.error"))
    return near.withColumn("place", F.row_number().over(own.orderBy(F.desc("alpha")))).where("place = 1").drop("place", "least")
