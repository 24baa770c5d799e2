"""Imputation, scaling, power transform and one-hot encoding."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cohortwise.bounded import attach, collect_bounded, narrow_batches, small_frame
from cohortwise.functions.columns import min_max, yeo_johnson, z_score
from cohortwise.operators.batches import add_moments, grouped, pooled_moments, present_values
from cohortwise.operators.stats import medians, profile


def wide(stats: DataFrame, cohort: str, value: str, prefix: str, features: Sequence[str]) -> DataFrame:
    """Turn (cohort, feature, value) into one row per cohort."""
    return stats.groupBy(cohort).agg(*[
        F.max(F.when(F.col("feature") == f, F.col(value))).alias(f"{prefix}{f}") for f in features])


def fill(df: DataFrame, fills: DataFrame, columns: Sequence[str], cohort: str) -> DataFrame:
    """Replace missing values by the per-cohort ``value`` of a (cohort, feature, value) table."""
    given = {r.feature for r in collect_bounded(fills.select("feature").distinct())}
    used = [c for c in columns if c in given]
    if not used:
        return df
    joined = attach(df, wide(fills, cohort, "value", "__fill_", used), [cohort])
    return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"__fill_{c}")) for c in used}) \
        .drop(*[f"__fill_{c}" for c in used])


def impute_median(df: DataFrame, columns: Sequence[str], cohort: str) -> DataFrame:
    return fill(df, medians(df, columns, [cohort]), columns, cohort)


def impute_mean(df: DataFrame, columns: Sequence[str], cohort: str) -> DataFrame:
    means = profile(df, columns, [cohort]).where("n < n_rows").select(cohort, "feature", F.col("mean").alias("value"))
    return fill(df, means, columns, cohort)


def _scale(df: DataFrame, columns, cohort, fields, expression, fit) -> DataFrame:
    stats = profile(df if fit is None else fit, columns, [cohort]).withColumn("deviation", F.sqrt("var_pop"))
    table = stats.groupBy(cohort).agg(*[
        F.max(F.when(F.col("feature") == c, F.col(f))).alias(f"__{f}_{c}") for c in columns for f in fields])
    joined = attach(df, table, [cohort])
    scaled = {c: expression(F.col(c), *[F.col(f"__{f}_{c}") for f in fields]) for c in columns}
    return joined.withColumns(scaled).drop(*[f"__{f}_{c}" for c in columns for f in fields])


def scale_min_max(df: DataFrame, columns: Sequence[str], cohort: str, fit: DataFrame | None = None) -> DataFrame:
    return _scale(df, columns, cohort, ("minimum", "maximum"), min_max, fit)


def scale_standard(df: DataFrame, columns: Sequence[str], cohort: str, fit: DataFrame | None = None) -> DataFrame:
    return _scale(df, columns, cohort, ("mean", "deviation"), z_score, fit)


COARSE_STEP, FINEST_STEP = 0.25, 0.025
COARSE_POWERS = tuple(float(x) for x in np.arange(-2.0, 2.01, COARSE_STEP))
#: Multiples of a step: beyond an edge, and around the best power so far.
BEYOND = tuple(float(k) for k in range(1, 9))
AROUND = tuple(k / 10 for k in range(-10, 11))


def _bent_moments(x: np.ndarray, powers: np.ndarray) -> Iterator[tuple[int, float, float]]:
    """Count, sum and squared deviations of the Yeo-Johnson transform of ``x`` for every power; one logarithm serves all."""
    size, low = np.log1p(np.abs(x)), x < 0
    mixed = low.any()
    for p in powers.tolist():
        bent = size if p == 0 else (np.exp(p * size) - 1.0) / p
        if mixed:
            bent = np.where(low, -size if p == 2 else -(np.exp((2.0 - p) * size) - 1.0) / (2.0 - p), bent)
        total = bent.sum()
        yield len(x), total, np.square(bent - total / len(x)).sum() if len(x) else 0.0


def power_likelihoods(df: DataFrame, columns: Sequence[str], cohort: str,
                      powers: Sequence[float] = COARSE_POWERS, centers: DataFrame | None = None) -> DataFrame:
    """Yeo-Johnson log-likelihood of every power of a grid, in one aggregation.

    (cohort, feature, power, loglik); with ``centers`` (cohort, feature, center, step)
    the grid holds multiples of each group's step from its center. The likelihood is
    NULL where the transformed values overflow or differ by rounding errors only.
    """
    columns, at = list(columns), None
    if centers is not None:
        at = {(r[cohort], r.feature): (r.center, r.step) for r in collect_bounded(centers) if r.center is not None}
    powers = np.array([float(p) for p in powers])
    schema = T.StructType([df.schema[cohort], *T.StructType.fromDDL("feature string, power double, n bigint, total double, spread double, shrink double")])
    arrow = to_arrow_schema(schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple, tuple] = {}
        for batch in batches:
            values = [present_values(batch.column(1 + k)) for k in range(len(columns))]
            for (key,), rows in grouped(batch, 1):
                for name, (x, present) in zip(columns, values):
                    if at is not None and (key, name) not in at:
                        continue
                    x = x[rows] if present is None else x[rows[present[rows]]]
                    grid = powers if at is None else at[key, name][0] + powers * at[key, name][1]
                    held, shrink = state.get((key, name), (None, 0.0))
                    with np.errstate(all="ignore"):
                        found = list(_bent_moments(x, grid))
                        state[key, name] = add_moments(held, *np.array(found).T), shrink + (np.sign(x) * np.log1p(np.abs(x))).sum()
        for (key, name), ((n, total, spread), shrink) in state.items():
            grid = powers if at is None else at[key, name][0] + powers * at[key, name][1]
            k = len(grid)
            rows = [key] * k, [name] * k, grid, n.astype(np.int64), total, spread, [shrink] * k
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(rows, arrow)], schema=arrow)

    partial = df.select(cohort, *[F.col(c).cast("double").alias(f"__{k}") for k, c in enumerate(columns)]).mapInArrow(fold, schema)
    sums = pooled_moments(partial, [cohort, "feature", "power"], F.sum("shrink").alias("shrink")) \
        .withColumnsRenamed({"mean": "level", "var_pop": "spread"})
    sound = (F.col("spread") > 1e-24 * F.col("level") * F.col("level")) & (F.col("spread") < float("inf"))
    loglik = -F.col("n") / 2.0 * F.log("spread") + (F.col("power") - 1.0) * F.col("shrink")
    return sums.select(cohort, "feature", "power", F.when(sound, loglik).alias("loglik"))


def best_powers(likelihoods: DataFrame, cohort: str) -> DataFrame:
    """(cohort, feature, power) with the highest likelihood; 1 where nothing varies."""
    return likelihoods.groupBy(cohort, "feature").agg(
        F.coalesce(F.max_by("power", "loglik"), F.lit(1.0)).alias("power"))


def fit_powers(df: DataFrame, columns: Sequence[str], cohort: str) -> DataFrame:
    """(cohort, feature, power): the best power in steps of 0.025 or less; 1 where nothing varies.

    A grid of -2 to 2 is looked at first. Where the best power is at its edge, eight powers beyond follow in steps
    of twice the size, until the best is inside. Then ever finer steps around it. There is no bound on the power.
    """
    spark, named = df.sparkSession, f"{cohort} string, feature string"
    best: dict[tuple, tuple[float, float | None]] = {}

    def look(grid: Sequence[float], at: dict[tuple, tuple[float, float]] | None = None) -> set[tuple]:
        """Look at a grid, around (center, step) of the groups in ``at``; returns the groups with a better power."""
        centers = None if at is None else small_frame(spark, [(*k, *v) for k, v in at.items()], f"{named}, center double, step double")
        found = power_likelihoods(df, columns, cohort, grid, centers).groupBy(cohort, "feature").agg(
            F.max_by("power", "loglik").alias("power"), F.max("loglik").alias("loglik"))
        better = set()
        with narrow_batches(df.select(cohort, *columns)):
            rows = collect_bounded(found)
        for r in rows:
            key = (r[cohort], r.feature)
            if key not in best:
                best[key] = (1.0, None)
            if r.loglik is not None and (best[key][1] is None or r.loglik > best[key][1]):
                best[key] = (r.power, r.loglik)
                better.add(key)
        return better

    at_edge = {k for k in look(COARSE_POWERS) if abs(best[k][0]) == COARSE_POWERS[-1]}
    steps = dict.fromkeys((k for k, (_, loglik) in best.items() if loglik is not None), COARSE_STEP)
    while at_edge:
        steps |= {k: 2 * steps[k] for k in at_edge}
        ahead = {k: (best[k][0], float(np.copysign(steps[k], best[k][0]))) for k in at_edge}
        better = look(BEYOND, ahead)
        at_edge = {k for k in better if best[k][0] == ahead[k][0] + BEYOND[-1] * ahead[k][1]}
    while around := {k: (best[k][0], step) for k, step in steps.items() if step > 1.001 * FINEST_STEP}:
        look(AROUND, around)
        steps |= {k: steps[k] / 10 for k in around}
    return small_frame(spark, [(*k, power) for k, (power, _) in best.items()], f"{named}, power double")


def power_transform(df: DataFrame, columns: Sequence[str], cohort: str, fit: DataFrame | None = None) -> DataFrame:
    """Yeo-Johnson with fitted powers, then standardised."""
    powers = fit_powers(df if fit is None else fit, columns, cohort)
    table = wide(powers, cohort, "power", "__p_", columns)

    def shaped(frame: DataFrame) -> DataFrame:
        joined = attach(frame, table, [cohort])
        return joined.withColumns({c: yeo_johnson(F.col(c).cast("double"), F.col(f"__p_{c}")) for c in columns}) \
            .drop(*[f"__p_{c}" for c in columns])

    bent = shaped(df)
    return scale_standard(bent, columns, cohort, None if fit is None else shaped(fit))


def one_hot(df: DataFrame, column: str, prefix: str = "is_") -> tuple[DataFrame, list[str]]:
    """One 0/1 column per category, in alphabetical order."""
    indexer = StringIndexer(inputCol=column, outputCol="__index", stringOrderType="alphabetAsc").fit(df)
    encoder = OneHotEncoder(inputCol="__index", outputCol="__hot", dropLast=False).fit(indexer.transform(df))
    names = [f"{prefix}{label}" for label in indexer.labels]
    hot = PipelineModel(stages=[indexer, encoder]).transform(df).withColumn("__hot", vector_to_array("__hot"))
    return hot.select(*df.columns, *[F.col("__hot")[i].alias(n) for i, n in enumerate(names)]), names
