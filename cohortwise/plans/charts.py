"""Tables behind the charts of an analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.config import CohortConfig
from cohortwise.functions.columns import title
from cohortwise.operators import stats
from cohortwise.operators.features import candidate_names


def target_distribution(df: DataFrame, target: str, cohort: str, bins: int = 40) -> DataFrame:
    """Histogram with density, and the cohort's mean and median on every bar."""
    summary = stats.describe(df, target, [cohort]).select(cohort, "mean", "median")
    return stats.histogram(df, target, cohort, bins).join(F.broadcast(summary), cohort)


def overlaid_distribution(df: DataFrame, target: str, cohort: str, bins: int = 35) -> DataFrame:
    return stats.histogram(df, target, cohort, bins).select(cohort, "bin", "low", "high", "density")


def correlation_bars(pairs: DataFrame, target: str, cohort: str) -> DataFrame:
    """Signed correlation of every feature with the target, with a display name."""
    bars = stats.target_correlations(pairs, target, cohort).where("corr is not null")
    return bars.select(cohort, "feature", title(F.col("feature")).alias("label"), "corr",
                       F.signum("corr").cast("int").alias("sign"))


def most_positive(correlations: DataFrame, cohort: str, k: int = 10) -> DataFrame:
    """The ``k`` most positive correlations of each cohort; equal ones by name."""
    window = Window.partitionBy(cohort).orderBy(F.round("corr", 12).desc_nulls_last(), "feature")
    ranked = correlations.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)
    return ranked.select(cohort, "feature", "corr", "rank")


def feature_summary(selection: DataFrame, config: CohortConfig, target: str) -> DataFrame:
    """Candidates, originals, engineered and selected features per cohort."""
    original = F.col("feature").isin(*config.originals)
    return selection.groupBy("cohort").agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if(original).alias("originals"),
        F.count_if(~original).alias("engineered"), F.count_if("selected").alias("selected"))


def original_correlations(df: DataFrame, target: str, config: CohortConfig) -> DataFrame:
    """Correlation matrix of the original features and the target, per cohort."""
    columns = [c for c in candidate_names(None, target, config) if c in config.originals] + [target]
    return stats.correlation_matrix(stats.correlation_pairs(df, columns, config.cohort), columns, config.cohort)
