"""Passes that linear models, targets and stored tables share."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortwise.models import linear, train
from cohortwise.operators.split import CODE, coded, with_split
from cohortwise.plans import catalog
from cohortwise.sources.tables import UNITS


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    n = 800
    pdf = pd.DataFrame({"cohort": np.where(np.arange(n) % 2 == 0, "a", "b"), "row_key": [hashlib.md5(str(v).encode()).hexdigest() for v in range(n)],
                        "x": 1e4 + rng.normal(size=n), "flat": 0.1})
    pdf["y"] = 3 * (pdf.x - 1e4) + rng.normal(size=n)
    return with_split(spark.createDataFrame(pdf)).repartition(5)


def test_sums_equal_numpy_far_from_zero_and_a_constant_has_none(rows):
    sums = linear.training_sums(rows.where("split = 'train'"), ["x", "flat"], "y", "cohort")
    pdf = rows.where("split = 'train'").toPandas()
    assert len(pdf) > 500 and set(sums) == {"a", "b"}
    for c, part in pdf.groupby("cohort"):
        found = linear.problem(sums[c], linear.FINAL, "none", ["x", "flat"], "y")
        centered = part[["x", "flat", "y"]] - part[["x", "flat", "y"]].mean()
        assert found.n == len(part) and found.center[1] == 0.1
        assert found.gram[0, 0] == pytest.approx((centered.x ** 2).sum(), rel=1e-9)
        assert found.moment[0] == pytest.approx((centered.x * centered.y).sum(), rel=1e-9)
        assert found.gram[1, 1] == found.gram[0, 1] == found.moment[1] == 0
        assert sums[c].by_fold.keys() == set(part.fold)


def test_models_of_one_table_share_its_sums(rows, monkeypatch):
    passes = []
    whole = linear.training_sums
    monkeypatch.setattr(linear, "training_sums", lambda *a: passes.append(a) or whole(*a))
    data = train.training_data(rows, "y", {"a": ["x"], "b": ["x"]}, UNITS)
    base = train.train_single_features(data).results
    train.train_single_features(data, "ridge", 10.0, "minmax", lambda f: f"Tuned {f}", "tuned")
    data.release()
    assert len(passes) == 1 and base.count() == 2


def test_a_coded_table_trains_alike(spark, rows):
    plain = rows.drop("split", "fold")
    kept = coded(plain)
    assert "row_key" not in kept.columns
    assert kept.select("split", "fold", CODE).exceptAll(with_split(plain).select("split", "fold", F.xxhash64("row_key"))).count() == 0
    results = []
    for df in (with_split(plain), kept):
        data = train.training_data(df, "y", {"a": ["x"], "b": ["x"]}, UNITS)
        trained = train.train_models(data, ["Ridge Regression", "Decision Tree"], cv=True).results
        results.append({(r.cohort, r.model): (r.test_mae, r.base_cv_mae_mean) for r in trained.collect()})
        data.release()
    assert results[0].keys() == results[1].keys() and len(results[0]) == 4
    for key, values in results[0].items():
        assert results[1][key] == pytest.approx(values, rel=1e-9)


def test_targets_share_one_join(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    n = 400
    key = np.arange(n)
    tables = {
        "lineitem": {"l_orderkey": key // 4, "l_linenumber": (key % 4 + 1).astype("int32"), "l_partkey": key % 20, "l_suppkey": key % 5,
                     "l_quantity": rng.integers(1, 50, n).astype(float), "l_extendedprice": rng.uniform(1e3, 5e4, n).round(2),
                     "l_discount": rng.integers(0, 10, n) / 100, "l_tax": rng.integers(0, 8, n) / 100, "l_linestatus": np.where(key % 3 == 0, "F", "O")},
        "orders": {"o_orderkey": key[:100], "o_custkey": key[:100] % 30, "o_totalprice": rng.uniform(1e3, 4e5, 100).round(2)},
        "customer": {"c_custkey": key[:30], "c_acctbal": rng.uniform(-900, 9000, 30).round(2)},
        "part": {"p_partkey": key[:20], "p_size": rng.integers(1, 50, 20).astype("int32"), "p_retailprice": rng.uniform(900, 2000, 20).round(2)}}
    for name, columns in tables.items():
        spark.createDataFrame(pd.DataFrame(columns)).write.parquet(str(tmp_path / f"{name}.parquet"))
    joins, units = [], catalog.units
    monkeypatch.setattr(catalog, "units", lambda *a: joins.append(a) or units(*a))
    board = catalog.best_of_runs(spark, str(tmp_path)).collect()
    assert len(joins) == 1
    assert {(r.target, r.run) for r in board} == {(t, t) for t in (catalog.MILEAGE, catalog.MAINTENANCE, catalog.RATIO)} and len(board) == 6
