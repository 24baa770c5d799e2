"""Ratio target, clamp, interquartile-range filter and row accounting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.bounded import attach
from cohortwise.config import CohortConfig
from cohortwise.functions.columns import clamp_lower, ratio
from cohortwise.operators.quantiles import approximate_quantiles, quantiles


def with_ratio(df: DataFrame, name: str, numerator: str, denominator: str) -> DataFrame:
    return df.withColumn(name, ratio(F.col(numerator), F.col(denominator)))


def clamp(df: DataFrame, columns: Sequence[str], floor: float = 0.0) -> DataFrame:
    """Raise values below ``floor``; columns the table does not have are skipped."""
    present = {c: clamp_lower(F.col(c), floor) for c in columns if c in df.columns}
    return df.withColumns(present) if present else df


def iqr_bounds(df: DataFrame, column: str, by: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """(by..., q1, q3, lower, upper) with the fences 1.5 interquartile ranges out."""
    by = list(by)
    source = df.select(*by, F.col(column))
    compute = quantiles if exact else approximate_quantiles
    long = compute(source, [column], [0.25, 0.75], by)
    at = lambda p: F.max(F.when(F.col("p") == p, F.col("value")))
    spread = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    return (
        long.groupBy(*by).agg(at(0.25).alias("q1"), at(0.75).alias("q3"))
        .withColumns({"lower": F.col("q1") - spread, "upper": F.col("q3") + spread})
    )


def remove_outliers(df: DataFrame, column: str, by: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """Keep rows inside the closed fences; missing values go, a missing column changes nothing.

    Pooled fences become literals, so the predicate can reach the scan.
    """
    if column not in df.columns:
        return df
    bounds = iqr_bounds(df, column, by, exact)
    if not by:
        row = bounds.first()
        if row is None or row.lower is None:
            return df.where(F.col(column).isNotNull())
        return df.where(F.col(column).between(F.lit(row.lower), F.lit(row.upper)))
    fences = bounds.select(*by, F.col("lower").alias("__lower"), F.col("upper").alias("__upper"))
    return (
        attach(df, fences, list(by))
        .where(F.col(column).between(F.col("__lower"), F.col("__upper")))
        .drop("__lower", "__upper")
    )


def outlier_accounting(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows before, kept and removed per group, with pooled fences."""
    row = iqr_bounds(df, column).first()
    inside = F.col(column).between(F.lit(row.lower), F.lit(row.upper))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_before"),
        F.count_if(inside).alias("n_kept"),
        (F.count(F.lit(1)) - F.count_if(inside)).alias("n_removed"),
    )


def prepare(df: DataFrame, target: str, config: CohortConfig, exact: bool = True) -> DataFrame:
    """Derive the ratio target, clamp, and drop outliers of ``target``."""
    ready = df
    if {config.ratio_numerator, config.ratio_denominator} <= set(df.columns):
        ready = with_ratio(df, config.ratio_name, config.ratio_numerator, config.ratio_denominator)
    ready = clamp(ready, config.clamped)
    by = [config.cohort] if config.outlier_scope == "cohort" else []
    return remove_outliers(ready, target, by, exact)


def only_cohort(df: DataFrame, cohort: str, config: CohortConfig) -> DataFrame:
    return df.where(F.col(config.cohort) == F.lit(cohort))
