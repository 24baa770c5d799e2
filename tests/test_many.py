import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortwise import VEHICLES
from cohortwise.models import linear, many
from cohortwise.models.train import training_data
from cohortwise.operators.split import with_split
from cohortwise.shipping import ship

NAMES = ["x", "z", "w"]
SPECS = [linear.LinearSpec("ols", "ols", scaler="none"), linear.LinearSpec("ridge", "ridge", 2.0, "standard"), linear.LinearSpec("lasso", "lasso", 0.3, "minmax")]


def test_equals_the_fits_of_few_cohorts(spark, monkeypatch):
    ship(spark)
    monkeypatch.setattr(many, "HELD_PARTS", 3)
    rng = np.random.default_rng(2)
    n = 700
    pdf = pd.DataFrame({"cohort": np.where(np.arange(n) % 3 == 0, "a", "b"), "k": np.arange(n), "x": rng.normal(1e4, 10, n), "z": rng.uniform(0, 1e-3, n), "w": rng.normal(-5, 2, n)})
    pdf["y"] = 3 * pdf.x + 2e4 * pdf.z - pdf.w + rng.normal(0, 5, n)
    df = with_split(spark.createDataFrame(pdf).withColumn("row_key", F.md5(F.col("k").cast("string"))))
    data = training_data(df, "y", {c: NAMES for c in "ab"}, VEHICLES)
    sums = linear.training_sums(data.train_rows, NAMES, "y", "cohort")
    fits = {(f.cohort, f.spec.name, f.left_out): f for f in linear.fit_all(sums, data.chosen, "y", SPECS)}
    scores = {(r.cohort, r.model, r.fold, r.split): r for r in linear.score(data.rows, "y", list(fits.values()), "cohort").collect()}
    got = many.fit_many(df, "y", NAMES, "cohort", SPECS).collect()
    assert {(r.cohort, r.model, r.left_out) for r in got} == set(fits)
    for r in got:
        fit = fits[r.cohort, r.model, r.left_out]
        assert r.intercept == pytest.approx(fit.intercept, rel=1e-7) and r.coefficients == pytest.approx(list(fit.coefficients), rel=1e-6, abs=1e-9)
        held = scores[r.cohort, r.model, r.left_out, "test" if r.left_out == -1 else "train"]
        assert (r.held_n, r.held_rmse, r.held_r2) == pytest.approx((held.n, held.rmse, held.r2), rel=1e-6)


def test_ten_thousand_cohorts(spark):
    """Every cohort has its own line; one cohort has a third of all rows."""
    ship(spark)
    many_ = spark.range(120_000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 10_000).alias("c"), "id")
    df = many_.select(F.col("c").cast("string").alias("cohort"), F.md5(F.col("id").cast("string")).alias("row_key"), (F.col("id") % 17).cast("double").alias("x"),
                      ((F.col("id") % 17) * F.col("c") + 5).cast("double").alias("y"))
    fits = many.fit_many(with_split(df), "y", ["x"], "cohort", SPECS[:1], folds=False)
    row = fits.agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("n") > 1, F.abs(F.col("coefficients")[0] - F.col("cohort").cast("double")))).alias("worst"), F.max("n").alias("most")).first()
    assert row.n == df.select("cohort").distinct().count() > 6_000 and row.worst < 1e-6 and row.most > 30_000


def test_unusual_rows(spark):
    ship(spark)
    rows = [("a", "train", 0, 1.0, 2.0), ("a", "train", None, 2.0, 4.0), ("a", "train", 1, None, 9.0), ("a", "train", 1, float("nan"), 9.0), ("a", "test", 0, 3.0, 7.0),
            ("b", "test", 0, 1.0, 1.0), (None, "train", 0, 1.0, 1.0), ("c", "train", 2, 1.0, 3.0), ("c", None, 2, 1.0, 3.0)]
    df = spark.createDataFrame(rows, "cohort string, split string, fold int, x double, y double")
    got = {(r.cohort, r.left_out): r for r in many.fit_many(df, "y", ["x"], "cohort", SPECS[:1]).collect()}
    assert set(got) == {("a", -1), ("a", 0), ("c", -1)}
    assert got["a", -1].coefficients == pytest.approx([2.0]) and got["a", -1].held_rmse == pytest.approx(1.0) and got["a", -1].n == 2
    assert got["a", 0].n == 1 and got["c", -1].held_n == 0 and got["c", -1].held_rmse is None and got["c", -1].train_r2 is None
    assert many.fit_many(df.limit(0), "y", ["x"], "cohort", SPECS).count() == 0


def test_tasks_solve_all_their_cohorts_at_once(spark, monkeypatch):
    """Cohorts that meet in tasks and cohorts folded where their rows lie give the same fits, and no solve is called for a single cohort."""
    ship(spark)
    rows = spark.range(30_000).select(F.when(F.col("id") % 4 == 0, "hot").otherwise((F.col("id") % 907).cast("string")).alias("cohort"), F.md5(F.col("id").cast("string")).alias("row_key"),
                                      (F.col("id") % 9 / 100).alias("x"), (F.col("id") % 11 / 10).alias("z"), (F.col("id") % 7).cast("double").alias("w"), (F.col("id") % 50 + 1).cast("double").alias("y"))
    df, seen = with_split(rows), []
    for limit in (10**9, 5000, 1):
        monkeypatch.setattr(many, "HOT_ROWS", limit)
        count, hot = many._hot(df, "cohort")
        seen.append(len(hot))
        fits = {(r.cohort, r.model, r.left_out): r for r in many.fit_many(df, "y", NAMES, "cohort", SPECS).collect()}
        first = fits if limit == 10**9 else first
        assert count == 30_000 and fits.keys() == first.keys()
        for key, r in fits.items():
            assert r[3:5] == pytest.approx(first[key][3:5], rel=1e-9, abs=1e-9) and r.coefficients == pytest.approx(first[key].coefficients, rel=1e-6, abs=1e-9), key
            for name in ("train_rmse", "train_r2", "held_n", "held_rmse", "held_r2"):
                assert (r[name] is None) == (first[key][name] is None) and (r[name] or 0.0) == pytest.approx(first[key][name] or 0.0, rel=1e-7, abs=1e-9), (key, name)
    assert seen[0] == 0 and seen[1] == 1 and seen[2] == df.select("cohort").distinct().count()


def test_stacked_solutions_equal_single_ones():
    """A whole task of small cohorts, with constant features and fewer rows than coefficients, against solves one by one."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    rows = pd.DataFrame({"cohort": rng.integers(0, 40, 400).astype(str), "part": rng.integers(-2, 3, 400), "v0": rng.integers(0, 3, 400) / 10, "v1": rng.normal(1e3, 1, 400), "v2": rng.normal(0, 1, 400)})
    rows.loc[rows.cohort == "7", "v0"] = 0.1
    rows["part"] = rows["part"].astype("Int32").mask(rows.index % 50 == 3)
    specs = [linear.LinearSpec("ols", "ols", scaler="none"), linear.LinearSpec("ridge", "ridge", 2.0, "standard"), linear.LinearSpec("lasso", "lasso", 0.01, "minmax")]
    batch = pa.RecordBatch.from_pandas(rows, schema=pa.schema([("cohort", pa.string()), ("part", pa.int32()), *((f"v{k}", pa.float64()) for k in range(3))]), preserve_index=False)
    got = pa.Table.from_batches(many._whole_solver(specs, True)(iter([batch]))).to_pylist()
    known = rows.dropna()
    want = sum(((0 if n == many.FINAL else 1) for n in known[known.part >= 0].drop_duplicates(["cohort", "part"]).part), 0)
    assert len({(r["cohort"], r["left_out"]) for r in got}) <= want + 40 and len(got) % 3 == 0
    for r in got:
        mine = known[(known.cohort == r["cohort"]) & (known.part != many.TEST) & (known.part != (r["left_out"] if r["left_out"] != many.FINAL else many.TEST))]
        x, y = mine[["v0", "v1"]].to_numpy(), mine.v2.to_numpy()
        assert r["n"] == len(mine)
        if r["model"] == "ols":
            a = x - x.mean(axis=0)
            size = np.sqrt((a * a).sum(axis=0))
            size[size < 1e-9] = 1.0
            w = np.linalg.lstsq(a / size, y - y.mean(), rcond=1e-6)[0] / size
            assert r["coefficients"] == pytest.approx(w, rel=1e-5, abs=1e-7), r
        error = r["intercept"] + x @ np.array(r["coefficients"]) - y
        assert r["train_rmse"] == pytest.approx(np.sqrt((error**2).mean()), rel=1e-6, abs=1e-6)


def test_quick_rounding_equals_the_usual_one(spark):
    from cohortwise.plans import catalog

    rng = np.random.default_rng(1)
    values = [*rng.normal(0, 50, 2000), *(rng.integers(-10**6, 10**6, 2000) / 1e6), *(rng.integers(-999, 999, 500) / 2e5), 1e9, -3.3e17, 1e308, 0.0, -0.0, -1e-9, float("nan"), float("inf"), None]
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double")
    for r in df.select("v", catalog.rounded(F.col("v"), 5, "a"), catalog.quickly_rounded(F.col("v"), 5, "b")).collect():
        assert repr(r.a) == repr(r.b), r
