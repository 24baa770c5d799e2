import pytest
from pyspark.sql import functions as F

from cohortwise.sources.sinks import RunStore

SCHEMA = "target string, cohort string, model string, test_r2 double, test_mae double"


def test_a_failed_run_is_never_seen(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "store"))
    assert store.read("rankings") is None and store.best() is None and store.manifests() == {}
    first = spark.createDataFrame([("t", "a", "m1", 0.5, 2.0), ("t", "b", "m1", None, 1.0)], SCHEMA)
    second = spark.createDataFrame([("t", "a", "m2", 0.7, 3.0), ("t", "b", "m0", 0.1, 5.0), ("t", "a", "m1", 0.7, 3.0)], SCHEMA)
    store.save({"rankings": first}, run="one")
    bad = first.withColumn("test_r2", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        store.save({"rankings": second, "importances": bad}, run="two")  # fails between two writes
    assert set(store.manifests()) == {"one"} and {r.run for r in store.read("rankings").collect()} == {"one"}
    with pytest.raises(RuntimeError):
        store.save({"rankings": second}, lambda folder: (_ for _ in ()).throw(RuntimeError("models")), "two")
    assert store.read("rankings").count() == 2
    store.save({"rankings": second, "extra": first}, run="two")
    assert store.read("rankings").count() == 5 and store.read("extra").count() == 2
    best = {r.cohort: (r.run, r.model) for r in store.best().collect()}
    assert best == {"a": ("two", "m1"), "b": ("two", "m0")}
    assert {r.cohort: r.run for r in store.best("test_mae").collect()} == {"a": "one", "b": "one"}
    with pytest.raises(ValueError, match="exists"):
        store.save({"rankings": first}, run="one")
    assert RunStore(spark, str(tmp_path / "store")).manifests()["two"]["tables"].keys() == {"rankings", "extra"}
