"""Regression metrics over predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def metric_columns(label: str = "label", prediction: str = "prediction") -> list[Column]:
    """MAE, RMSE and R2 as plain aggregates; R2 is NULL for a constant label."""
    error = F.col(prediction) - F.col(label)
    unexplained = F.try_divide(F.avg(error * error), F.var_pop(label))
    return [
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (F.lit(1.0) - unexplained).alias("r2"),
    ]


def regression_metrics(predictions: DataFrame, by: Sequence[str], label: str = "label",
                       prediction: str = "prediction") -> DataFrame:
    return predictions.groupBy(*by).agg(*metric_columns(label, prediction))


def predicted_vs_actual(predictions: DataFrame, keep: Sequence[str], label: str = "label",
                        prediction: str = "prediction") -> DataFrame:
    return predictions.select(*keep, F.col(label).alias("actual"), F.col(prediction).alias("predicted"),
                              (F.col(label) - F.col(prediction)).alias("residual"))
