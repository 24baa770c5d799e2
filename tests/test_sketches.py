"""Quantile states: ranks within the bound, merged loads, retries, groups without values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortwise.operators import sketches


def test_states_of_loads_merge_within_the_bound(spark, tmp_path):
    k, path = 64, str(tmp_path / "states")
    df = spark.range(120_000, numPartitions=6).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise("rest").alias("g"), F.pow(F.rand(7) - 0.5, F.lit(3)).alias("x"))
    loads = df.withColumn("part", F.pmod(F.xxhash64("x"), F.lit(5))).cache()
    for load in range(5):
        sketches.store_states(sketches.quantile_states(loads.where(F.col("part") == load), ["x"], ["g"], k), path, f"day-{load}")
    sketches.store_states(sketches.quantile_states(loads.where("part = 4"), ["x"], ["g"], k), path, "day-4")  # a retry
    found = sketches.state_quantiles(sketches.stored_states(spark, path, ["g"]), [0.01, 0.25, 0.5, 0.9], ["g"]).cache()
    values = {}
    for r in loads.select("g", "x").collect():
        values.setdefault(r.g, []).append(r.x)
    rows = found.collect()
    assert len(rows) == 12
    for r in rows:
        own = np.array(values[r.g])
        assert r.n == len(own) and abs(np.mean(own <= r.value) - r.p) <= 3 * sketches.rank_error(k)
    checked = sketches.rank_check(loads, found, "x", ["g"], 3 * sketches.rank_error(k))
    assert checked.count() == 12 and checked.where("NOT within OR within IS NULL").count() == 0
    wrong = sketches.rank_check(loads, found.withColumn("p", F.lit(1.0) - F.col("p") / 4), "x", ["g"], 3 * sketches.rank_error(k))
    assert wrong.where("p > 0.8 AND p < 0.99 AND within").count() == 0


def test_missing_values_and_empty_tables(spark, tmp_path):
    nan = float("nan")
    df = spark.createDataFrame([("a", 1.0), ("a", nan), ("a", None), ("a", 3.0), ("b", nan), (None, 5.0)], "g string, x double")
    got = {(r.g, r.p): (r.n, r.value) for r in sketches.state_quantiles(sketches.merged_states(sketches.quantile_states(df, ["x"], ["g"]), ["g"]), [0.0, 1.0], ["g"]).collect()}
    assert got == {("a", 0.0): (2, 1.0), ("a", 1.0): (2, 3.0), ("b", 0.0): (0, None), ("b", 1.0): (0, None), (None, 0.0): (1, 5.0), (None, 1.0): (1, 5.0)}
    assert sketches.quantile_states(df.limit(0), ["x"], ["g"]).count() == 0
    with pytest.raises(ValueError, match="named by"):
        sketches.store_states(sketches.quantile_states(df, ["x"]), str(tmp_path), "../other")
