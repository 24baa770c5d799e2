"""Quantile states that are stored once per load and merged for appended data.

A state is one mergeable sketch per group and column. Appending rows adds one state table for the new rows alone; reading
merges the states, so old rows are never scanned again. A quantile from a state has a rank within ``rank_error`` of the
one asked for, whatever the order or number of merges; states of fewer than ``k`` values are exact in rank.

Defined cases: NULL and NaN are missing; a group or column without any value has n 0 and NULL quantiles. NULL group keys
are a group of their own. A state written again under the same load name replaces the earlier one, so a repeated load
does not count twice.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.functions.columns import nan_to_null

#: Values a sketch keeps at its widest level.
SIZE = 4096


def rank_error(k: int = SIZE) -> float:
    """Bound on the error of a rank, as a share of n, that holds for about 99 of 100 quantiles."""
    return 2.446 / k ** 0.9433


def quantile_states(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), k: int = SIZE) -> DataFrame:
    """(by..., feature, n, state): partial sketches are merged after the shuffle, rows never travel."""
    value = lambda c: nan_to_null(F.col(c).cast("double"))
    sketched = df.groupBy(*by).agg(*[
        F.struct(F.lit(c).alias("feature"), F.count(value(c)).alias("n"), F.kll_sketch_agg_double(value(c), F.lit(k)).alias("state")).alias(f"__s{i}")
        for i, c in enumerate(columns)])
    return sketched.select(*by, F.inline(F.array(*[F.col(f"__s{i}") for i in range(len(columns))])))


def merged_states(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """States of several loads as one per group and column."""
    return states.groupBy(*by, "feature").agg(F.sum("n").alias("n"), F.kll_merge_agg_double(F.when(F.col("n") > 0, F.col("state"))).alias("state"))


def store_states(states: DataFrame, path: str, load: str) -> None:
    """Write the states of one load; the name of the load makes a retry harmless."""
    if not re.fullmatch(r"[A-Za-z0-9-]+", load):
        raise ValueError(f"a load is named by letters, digits and hyphens, not {load!r}")
    states.write.mode("overwrite").parquet(os.path.join(path, f"load={load}"))


def stored_states(spark: SparkSession, path: str, by: Sequence[str] = ()) -> DataFrame:
    return merged_states(spark.read.parquet(path).drop("load"), by)


def state_quantiles(states: DataFrame, probabilities: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., feature, p, n, value) from merged states."""
    # The function takes constant ranks only.
    cells = [F.struct(F.lit(p).alias("p"), F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("state", F.lit(p))).alias("value"))
             for p in map(float, probabilities)]
    return states.select(*by, "feature", "n", F.inline(F.array(*cells))).select(*by, "feature", "p", "n", "value")


def rank_check(df: DataFrame, found: DataFrame, column: str, by: Sequence[str], error: float) -> DataFrame:
    """Adds ``within``: do the exact counts below and up to each value enclose its rank, give or take ``error`` * n? One pass over ``df``.

    ``found`` has one row per group and probability, so groups should be few; it is joined by group, which adaptive
    execution splits where a group is hot, and counted before the shuffle.
    """
    same = F.lit(True)
    for b in by:
        same = same & F.col(f"__{b}").eqNullSafe(F.col(b))
    asked = found.where(F.col("feature") == column)
    quantiles = asked.groupBy(*by).agg(F.array_sort(F.collect_set("value")).alias("values"))
    rows = df.select(*[F.col(b).alias(f"__{b}") for b in by], nan_to_null(F.col(column).cast("double")).alias("__v")).where("__v IS NOT NULL")
    met = rows.join(quantiles, same).select(*by, "__v", F.explode("values").alias("value"))
    counted = met.groupBy(*by, "value").agg(F.count_if(F.col("__v") < F.col("value")).alias("below"), F.count_if(F.col("__v") <= F.col("value")).alias("upto"))
    counted = counted.select(*[F.col(b).alias(f"__{b}") for b in by], F.col("value").alias("__value"), "below", "upto")
    low, high = F.col("below") - F.col("n") * F.lit(error), F.col("upto") + F.col("n") * F.lit(error)
    joined = asked.join(counted, same & (F.col("value") == F.col("__value")), "left")
    return joined.select(*by, "feature", "p", "n", "value", (F.col("p") * F.col("n")).between(low - 1, high + 1).alias("within"))
