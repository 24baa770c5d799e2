import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortwise.operators import select, tiles
from cohortwise.operators.stats import correlation_pairs
from cohortwise.shipping import ship


def _frame(rows=300, k=11, gaps=True):
    rng = np.random.default_rng(5)
    values = rng.normal(size=(rows, k)) @ rng.normal(size=(k, k)) + rng.normal(size=k) * 1e4
    values[:, 3] = 7.25
    if gaps:
        values[rng.random(values.shape) < 0.15] = np.nan
    pdf = pd.DataFrame(values, columns=[f"c{i}" for i in range(k)])
    pdf.insert(0, "cohort", np.where(np.arange(rows) % 3 == 0, "a", "b"))
    pdf["i"] = "clashes with the names of the sums"
    return pdf, [f"c{i}" for i in range(k)]


@pytest.mark.parametrize("gaps,width,held", [(True, 4, 1 << 28), (False, 4, 1), (True, 64, 1)])
def test_tiles_equal_pandas_and_the_whole_matrix(spark, monkeypatch, gaps, width, held):
    ship(spark)
    monkeypatch.setattr(tiles, "HELD_BYTES", held)
    pdf, names = _frame(gaps=gaps)
    df = spark.createDataFrame(pdf).repartition(7)
    got = {(r.cohort, r.a, r.b): r for r in tiles.tiled_correlation_pairs(df, names, "cohort", width=width, states=3).collect()}
    whole = {(r.cohort, r.a, r.b): r for r in correlation_pairs(df, names, "cohort").collect()} if not gaps else {}
    assert len(got) == 2 * 11 * 10 // 2
    for c in "ab":
        want = pdf[pdf.cohort == c][names].corr()
        for k, a in enumerate(names):
            for b in names[k + 1:]:
                r = got[c, a, b]
                assert r.n == pdf[pdf.cohort == c][[a, b]].dropna().shape[0]
                if "c3" in (a, b):
                    assert r["corr"] is None
                else:
                    assert r["corr"] == pytest.approx(want.loc[a, b], abs=1e-9)
                if whole:
                    assert whole[c, a, b]["corr"] == pytest.approx(r["corr"], abs=1e-12) if r["corr"] is not None else whole[c, a, b]["corr"] is None


def test_missing_cohorts_empty_tables_and_void_columns(spark):
    ship(spark)
    schema = "cohort string, x double, y double, z double"
    df = spark.createDataFrame([("a", 1.0, 2.0, None), ("a", 2.0, 4.0, None), ("a", 3.0, float("nan"), None), (None, 9.0, 1.0, 1.0)], schema)
    got = {(r.a, r.b): (r.n, r["corr"]) for r in tiles.tiled_correlation_pairs(df, ["x", "y", "z"], "cohort", width=2).collect()}
    assert got == {("x", "y"): (2, 1.0), ("x", "z"): (0, None), ("y", "z"): (0, None)}
    assert tiles.tiled_correlation_pairs(df.limit(0), ["x", "y", "z"], "cohort", width=2).count() == 0
    with pytest.raises(ValueError):
        tiles.tiled_correlation_pairs(df, ["x", "x"], "cohort")


def test_a_tile_reads_its_own_columns(spark, tmp_path):
    pdf, names = _frame(rows=40, gaps=False)
    spark.createDataFrame(pdf).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    shifts = {c: {n: (0.0, 1.0) for n in names} for c in "ab"}
    leaves = tiles.tiled_pair_sums(df, names, ["cohort"], shifts, width=4)._jdf.queryExecution().sparkPlan().collectLeaves()
    read = [leaves.apply(k).output().size() for k in range(leaves.size())]
    assert sorted(read) == [1 + n for n in (3, 4, 4, 7, 7, 8)]


def test_selection_takes_tiles_for_wide_tables(spark, vehicles, monkeypatch):
    from cohortwise import VEHICLES
    from cohortwise.operators.features import engineer
    from cohortwise.plans.runs import prepared_table
    from cohortwise.sources.tables import as_cohort_table

    ship(spark)
    df = engineer(prepared_table(as_cohort_table(vehicles), "mileage_km", VEHICLES), "mileage_km", VEHICLES).persist()
    few = select.select_features(df, "mileage_km", VEHICLES)
    monkeypatch.setattr(select, "WIDTH", 6)
    many = select.select_features(df, "mileage_km", VEHICLES)
    assert many.chosen == few.chosen
    df.unpersist()
