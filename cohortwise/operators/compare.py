"""Ranking, pivoting and comparing result tables.

These tables hold one row per target, cohort and model; the windows below
partition results, never data rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.models.registry import LINEAR_KINDS

TUNED_PREFIX = "Tuned "


def _groups(results: DataFrame) -> list[str]:
    return [c for c in ("target", "cohort") if c in results.columns]


def rank_models(results: DataFrame, by: str = "r2") -> DataFrame:
    """Number the models of each target and cohort by R2 (falling) or MAE (rising)."""
    if by.lower() in ("mae", "test_mae"):
        order = F.col("test_mae").asc_nulls_last()
    else:
        order = F.col("test_r2").desc_nulls_last()
    window = Window.partitionBy(*_groups(results)).orderBy(order, F.col("model"))
    return results.withColumn("rank", F.row_number().over(window))


def top_models(results: DataFrame, k: int, by: str = "r2") -> DataFrame:
    return rank_models(results, by).where(F.col("rank") <= k)


def best_model(results: DataFrame, by: str = "r2") -> DataFrame:
    return top_models(results, 1, by).drop("rank")


def append_tuned(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """Base and tuned rows together; a tuned row replaces an equally named one."""
    keys = [*_groups(base), "model"]
    kept = base.join(tuned.select(*keys), keys, "left_anti")
    return kept.unionByName(tuned, allowMissingColumns=True)


def tuned_vs_base(results: DataFrame) -> DataFrame:
    """Improvement of each tuned model over its base: positive is better in both columns."""
    keys = _groups(results)
    tuned = results.where(F.col("model").startswith(TUNED_PREFIX)).select(
        *keys, F.regexp_replace("model", f"^{TUNED_PREFIX}", "").alias("base_model"),
        F.col("test_mae").alias("tuned_mae"), F.col("test_r2").alias("tuned_r2"))
    base = results.select(*keys, F.col("model").alias("base_model"), F.col("test_mae").alias("base_mae"),
                          F.col("test_r2").alias("base_r2"))
    return tuned.join(base, [*keys, "base_model"]).select(
        *keys, "base_model", "base_mae", "tuned_mae", "base_r2", "tuned_r2",
        (F.col("base_mae") - F.col("tuned_mae")).alias("mae_gain"),
        (F.col("tuned_r2") - F.col("base_r2")).alias("r2_gain"))


def train_test_gap(results: DataFrame) -> DataFrame:
    """Overfitting monitor: R2 lost and MAE ratio between training and test rows."""
    return results.select(
        *_groups(results), "model",
        (F.col("train_r2") - F.col("test_r2")).alias("r2_gap"),
        F.try_divide("test_mae", "train_mae").alias("mae_ratio"))


def linear_only(scaler_results: DataFrame, models: Sequence[str] = tuple(LINEAR_KINDS)) -> DataFrame:
    return scaler_results.where(F.col("model").isin(*models))


def scaler_summary(scaler_results: DataFrame, digits: int = 4) -> DataFrame:
    """Mean, deviation and range of R2 and MAE per cohort and scaler."""
    r = lambda c: F.round(c, digits)
    parts = [r(fn(c)).alias(f"{c}_{name}") for c in ("test_r2", "test_mae")
             for name, fn in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    parts += [r(F.avg("cv_mae_mean")).alias("cv_mae_mean_mean"), r(F.stddev_samp("cv_mae_mean")).alias("cv_mae_mean_std")]
    return scaler_results.groupBy("cohort", "scaler").agg(*parts)


def group_means(scaler_results: DataFrame, by: Sequence[str], digits: int = 4) -> DataFrame:
    return scaler_results.groupBy(*by).agg(
        F.round(F.avg("test_r2"), digits).alias("test_r2"), F.round(F.avg("test_mae"), digits).alias("test_mae"))


def best_rows(scaler_results: DataFrame) -> DataFrame:
    """The row with the highest R2 and the one with the lowest MAE, per cohort."""
    name = F.concat_ws(" + ", "scaler", "model")
    ordered = lambda order, label: scaler_results.withColumn(
        "place", F.row_number().over(Window.partitionBy("cohort").orderBy(order, "scaler", "model"))) \
        .where("place = 1").select("cohort", F.lit(label).alias("criterion"), name.alias("combination"), "test_r2", "test_mae")
    return ordered(F.col("test_r2").desc_nulls_last(), "r2").unionByName(ordered(F.col("test_mae").asc_nulls_last(), "mae"))


def rank_scalers(scaler_results: DataFrame) -> DataFrame:
    means = scaler_results.groupBy("cohort", "scaler").agg(F.avg("test_r2").alias("mean_r2"), F.avg("test_mae").alias("mean_mae"))
    window = Window.partitionBy("cohort").orderBy(F.col("mean_r2").desc_nulls_last(), "scaler")
    return means.withColumn("rank", F.row_number().over(window))


def overall_best_scaler(scaler_results: DataFrame) -> DataFrame:
    """Scaler with the best mean R2 and scaler with the best mean MAE over everything."""
    means = scaler_results.groupBy("scaler").agg(F.avg("test_r2").alias("r2"), F.avg("test_mae").alias("mae"))
    return means.agg(F.max_by("scaler", "r2").alias("best_by_r2"), F.min_by("scaler", "mae").alias("best_by_mae"))


def pivot_scalers(scaler_results: DataFrame, value: str, cohorts: Sequence[str]) -> DataFrame:
    """Scaler by cohort, mean of one metric."""
    return scaler_results.groupBy("scaler").pivot("cohort", list(cohorts)).agg(F.avg(value))


def pivot_details(scaler_results: DataFrame, scalers: Sequence[str], digits: int = 4) -> DataFrame:
    """Cohort and model by scaler, three metrics side by side."""
    metrics = ("test_r2", "test_mae", "cv_mae_mean")
    return scaler_results.groupBy("cohort", "model").pivot("scaler", list(scalers)).agg(
        *[F.round(F.avg(m), digits).alias(m) for m in metrics])


def models_by_cohort(results: DataFrame, first: str, second: str, metrics: Sequence[str] = ("test_r2", "test_mae")) -> DataFrame:
    """Models both cohorts have, their metrics side by side."""
    side = lambda cohort, tag: results.where(F.col("cohort") == cohort).select(
        "model", *[F.col(m).alias(f"{m}_{tag}") for m in metrics])
    return side(first, "first").join(side(second, "second"), "model")


def cv_stability(results: DataFrame, first: str, second: str) -> DataFrame:
    """Cross-validated MAE and its deviation for models that have both, side by side."""
    scored = results.where("base_cv_mae_mean is not null and base_cv_mae_std is not null")
    return models_by_cohort(scored, first, second, ("base_cv_mae_mean", "base_cv_mae_std"))


def most_predictable(results: DataFrame) -> DataFrame:
    """Per target, the cohort whose best model has the highest R2, and its lead."""
    best = results.groupBy("target", "cohort").agg(F.max("test_r2").alias("best_r2"))
    return best.groupBy("target").agg(
        F.max_by("cohort", "best_r2").alias("cohort"), F.max("best_r2").alias("best_r2"),
        (F.max("best_r2") - F.min("best_r2")).alias("lead"))


def leaderboard(results: DataFrame, cohorts: Sequence[str], by: str = "r2") -> DataFrame:
    """Best model, R2 and MAE of every target, one column set per cohort."""
    return best_model(results, by).groupBy("target").pivot("cohort", list(cohorts)).agg(
        F.first("model").alias("model"), F.first("test_r2").alias("test_r2"), F.first("test_mae").alias("test_mae"))


def top_importances(importances: DataFrame, k: int = 15) -> DataFrame:
    window = Window.partitionBy(*_groups(importances), "model").orderBy(F.col("importance").desc(), "feature")
    return importances.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def feature_name_sets(chosen: DataFrame, cohort: str, first: str, second: str) -> DataFrame:
    """Names in either cohort, with where they occur: union, intersection and difference at once."""
    one = chosen.where(F.col(cohort) == first).select("feature").distinct()
    two = chosen.where(F.col(cohort) == second).select("feature").distinct()
    tagged = one.intersect(two).withColumn("membership", F.lit("both")) \
        .union(one.exceptAll(two).withColumn("membership", F.lit("first_only"))) \
        .union(two.exceptAll(one).withColumn("membership", F.lit("second_only")))
    return tagged.orderBy("feature")
