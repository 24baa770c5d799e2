import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, GBTRegressor
from pyspark.sql import functions as F

from cohortwise import VEHICLES
from cohortwise.models import linear, registry
from cohortwise.models import train
from cohortwise.models.train import Search, train_models, training_data
from cohortwise.operators import compare
from cohortwise.operators.evaluate import regression_metrics
from cohortwise.operators.split import with_split
from cohortwise.plans import runs
from cohortwise.sources import sinks
from cohortwise.sources.tables import as_cohort_table


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(17)
    n = 500
    pdf = pd.DataFrame({"cohort": np.where(np.arange(n) % 3 == 0, "a", "b"), "k": np.arange(n),
                        "x": rng.normal(50, 10, n), "z": rng.uniform(0, 1e-3, n), "w": rng.normal(1e5, 1e4, n)})
    pdf["y"] = 3 * pdf.x + 2e4 * pdf.z - 1e-3 * pdf.w + rng.normal(0, 5, n) + 40
    df = spark.createDataFrame(pdf).withColumn("row_key", F.md5(F.col("k").cast("string")))
    return with_split(df)


@pytest.fixture(scope="module")
def data(table):
    return training_data(table, "y", {"a": ["x", "z", "w"], "b": ["x", "z", "w"]}, VEHICLES)


def _matrix(data, cohort, fold=None):
    pdf = data.rows.toPandas()
    pdf = pdf[(pdf.cohort == cohort) & (pdf.split == "train")]
    pdf = pdf if fold is None else pdf[pdf.fold != fold]
    return pdf[["x", "z", "w"]].to_numpy(), pdf.y.to_numpy()


def test_least_squares_equals_numpy_and_spark_ml(data):
    sums = linear.training_sums(data.train_rows, ["x", "z", "w"], "y", "cohort")
    for fold in (linear.FINAL, 2):
        X, y = _matrix(data, "b", None if fold == linear.FINAL else fold)
        expected = np.linalg.lstsq(np.c_[np.ones(len(y)), X], y, rcond=None)[0]
        _, intercept, w = linear.solve(sums["b"], fold, linear.LinearSpec("o", "ols"), ["x", "z", "w"], "y")
        assert np.allclose(w, expected[1:], rtol=1e-8) and intercept == pytest.approx(expected[0], rel=1e-8)
    rows = data.train_rows.where("cohort = 'b'")
    vectors = VectorAssembler(inputCols=["x", "z", "w"], outputCol="features").transform(rows)
    model = LinearRegression(labelCol="y", solver="normal").fit(vectors)
    _, intercept, w = linear.solve(sums["b"], linear.FINAL, linear.LinearSpec("o", "ols"), ["x", "z", "w"], "y")
    assert np.allclose(w, model.coefficients.toArray(), rtol=1e-6)


@pytest.mark.parametrize("scaler", linear.SCALERS)
@pytest.mark.parametrize("alpha", [0.01, 1.0, 50.0])
def test_ridge_and_lasso_optimality(data, scaler, alpha):
    sums = linear.training_sums(data.train_rows, ["x", "z", "w"], "y", "cohort")["a"]
    X, y = _matrix(data, "a")
    size = {"minmax": np.ptp(X, axis=0), "standard": X.std(0), "none": np.ones(3)}[scaler]
    Z = (X - X.mean(0)) / size
    _, _, w = linear.solve(sums, linear.FINAL, linear.LinearSpec("r", "ridge", alpha, scaler), ["x", "z", "w"], "y")
    expected = np.linalg.solve(Z.T @ Z + alpha * np.eye(3), Z.T @ (y - y.mean()))
    assert np.allclose(w * size, expected, rtol=1e-6)
    _, _, w = linear.solve(sums, linear.FINAL, linear.LinearSpec("l", "lasso", alpha, scaler), ["x", "z", "w"], "y")
    beta = w * size
    gradient = Z.T @ (y - y.mean() - Z @ beta) / len(y)
    for g, b in zip(gradient, beta):  # subgradient conditions of the penalised problem
        assert (abs(g - alpha * np.sign(b)) < 1e-5 * max(1, alpha)) if b else abs(g) <= alpha * (1 + 1e-6)


def test_duplicate_columns_do_not_break_least_squares(spark, table):
    doubled = table.withColumn("x2", F.col("x") * 1.0)
    data = training_data(doubled, "y", {"a": ["x", "x2"]}, VEHICLES)
    results, _ = train.train_linear(data, [registry.OLS])
    alone, _ = train.train_linear(training_data(table, "y", {"a": ["x"]}, VEHICLES), [registry.OLS])
    assert results[0]["test_mae"] == pytest.approx(alone[0]["test_mae"], rel=1e-6)


def test_scores_equal_metrics_of_the_saved_formula(data, tmp_path):
    trained = train_models(data, [registry.RIDGE])
    row = trained.results.where("cohort = 'a'").first()
    sinks.save_model(trained.models["a", registry.RIDGE], str(tmp_path), "y", "a")
    scored = sinks.load_model(str(tmp_path), "y", "a").transform(data.rows.where("cohort = 'a' and split = 'test'"))
    check = regression_metrics(scored, [], "y").first()
    assert (row.test_mae, row.test_rmse, row.test_r2) == pytest.approx((check.mae, check.rmse, check.r2), rel=1e-9)


def test_no_row_is_lost_to_a_gap(table):
    import dataclasses
    gaps = table.withColumn("x", F.when((F.col("split") == "train") | (F.col("k") % 2 == 0), F.col("x")))
    config = dataclasses.replace(VEHICLES, fit_on="train")
    data = training_data(gaps, "y", {"a": ["x", "z"], "b": ["x", "z"]}, config)
    trained = train_models(data, [registry.OLS, registry.TREE], cv=False)
    assert trained.results.where("status <> 'ok' or test_mae is null").count() == 0
    rows = gaps.where("cohort = 'a' and split = 'test'")
    assert rows.where("x is null").count() > 0
    for name in (registry.OLS, registry.TREE):
        scored = trained.models["a", name].transform(rows.withColumn("z", F.lit(None).cast("double")))
        assert scored.count() == rows.count() and scored.where("prediction is null").count() == 0
        reported = trained.results.where((F.col("cohort") == "a") & (F.col("model") == name)).first().test_mae
        check = regression_metrics(trained.models["a", name].transform(rows), [], "y").first()
        assert check.mae == pytest.approx(reported, rel=1e-9)
    with pytest.raises(ValueError, match="without any value"):
        training_data(table.withColumn("void", F.lit(None).cast("double")), "y", {"a": ["void"]}, VEHICLES)


def test_saved_formula_of_features_with_similar_names(table):
    df = table.withColumns({"a": F.col("x"), "x_a": F.col("z") * 1e5, "x_x_a": F.col("w") / 1e3})
    data = training_data(df, "y", {"b": ["a", "x_a", "x_x_a"]}, VEHICLES)
    trained = train_models(data, [registry.OLS])
    check = regression_metrics(trained.models["b", registry.OLS].transform(df.where("cohort = 'b' and split = 'test'")), [], "y").first()
    assert check.mae == pytest.approx(trained.results.first().test_mae, rel=1e-9)


def test_rows_without_split_or_fold_are_counted(table):
    df = table.withColumn("split", F.when(F.col("k") % 10 > 0, F.col("split"))).withColumn("fold", F.when(F.col("k") % 7 > 0, F.col("fold")))
    data = training_data(df, "y", {"b": ["x"]}, VEHICLES)
    _, scores, _ = train.linear_scores(data, [linear.LinearSpec("o", "ols", 0.0, "none")])
    counted = {r.split: r.n for r in scores.where("stage = 'final'").collect()}
    want = {r.split: r["count"] for r in df.where("cohort = 'b'").groupBy("split").count().collect()}
    assert counted == want


def test_cross_validation_equals_a_manual_loop(data):
    record = next(r for r in train.train_linear(data, [registry.OLS])[0] if r["cohort"] == "b")
    pdf = data.rows.toPandas()
    pdf = pdf[(pdf.cohort == "b") & (pdf.split == "train")]
    maes = []
    for fold in range(5):
        fit, held = pdf[pdf.fold != fold], pdf[pdf.fold == fold]
        w = np.linalg.lstsq(np.c_[np.ones(len(fit)), fit[["x", "z", "w"]]], fit.y, rcond=None)[0]
        maes.append(np.abs(np.c_[np.ones(len(held)), held[["x", "z", "w"]]] @ w - held.y).mean())
    assert record["base_cv_mae_mean"] == pytest.approx(np.mean(maes), rel=1e-8)
    assert record["base_cv_mae_std"] == pytest.approx(np.std(maes), rel=1e-6)


def test_constant_label_has_no_r2(spark):
    df = spark.createDataFrame([(1.0, 1.5), (1.0, 0.5)], "label double, prediction double")
    row = regression_metrics(df, []).first()
    assert row.r2 is None and row.mae == 0.5


def test_a_failing_model_is_reported_and_the_others_continue(data):
    broken = registry.TreeSpec("Broken", GBTRegressor, {"maxIter": -1})
    trees = {**registry.tree_models("small"), "Broken": broken}
    trained = train_models(data, ["Broken", registry.TREE], cv=False, trees=trees)
    status = {(r.cohort, r.model): (r.status, r.error) for r in trained.results.collect()}
    assert status["a", registry.TREE][0] == "ok" and status["a", "Broken"][0] == "failed" and status["a", "Broken"][1]


def test_tree_importances_sum_to_one_and_search_picks_the_best(data):
    trained = train_models(data, [registry.TREE], cv=False)
    total = trained.importances.groupBy("cohort", "model").agg(F.sum("importance").alias("s")).collect()
    assert all(r.s == pytest.approx(1.0) for r in total)
    spec = registry.tree_models("small")[registry.TREE]
    table = train.multi_metric_search(data, "a", spec, [{"maxDepth": 1}, {"maxDepth": 4}]).collect()
    best = min(table, key=lambda r: r.cv_mae)
    assert [r.candidate for r in table if r.chosen] == [best.candidate]


def test_fine_tuning_adds_tuned_rows(data):
    base = train_models(data, [registry.RIDGE, registry.LASSO], cv=False)
    tuned = train.finetune_top(data, base.results, search=Search(iterations=5, spaces=registry.FINE_SPACES))
    merged = compare.append_tuned(base.results, tuned.results)
    assert {r.model for r in tuned.results.collect()} == {f"Tuned {registry.RIDGE}", f"Tuned {registry.LASSO}"}
    assert merged.count() == 8 and compare.tuned_vs_base(merged).count() == 4


def test_scaler_comparison_covers_the_grid(data):
    rows = train.compare_scalers(data, [registry.TREE]).collect()
    assert len(rows) == 2 * 4 * 4
    by = {(r.cohort, r.scaler, r.model): r for r in rows}
    ols = [by["a", s, registry.OLS].test_mae for s in ("MinMaxScaler", "StandardScaler", "NoScaling")]
    assert ols == pytest.approx([ols[0]] * 3, rel=1e-8)


def test_search_spaces_translate_to_spark():
    assert registry.spark_params({"n_estimators": 50, "max_depth": None, "min_samples_split": 20, "min_samples_leaf": 4}, False) == {
        "numTrees": 50, "maxDepth": 30, "minInstancesPerNode": 10}
    assert registry.spark_params({"n_estimators": 200, "learning_rate": 0.1, "subsample": 0.8, "colsample": 0.6}, True) == {
        "maxIter": 200, "stepSize": 0.1, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.6"}
    points = registry.random_points(registry.SEARCH_SPACES[registry.FOREST], 30)
    assert len(points) == 30 and len({tuple(p.items()) for p in points}) == 30
    assert registry.random_points(registry.SEARCH_SPACES[registry.RIDGE], 30) == registry.grid(registry.SEARCH_SPACES[registry.RIDGE])
    for p in registry.range_points(registry.RANGES[registry.SUBSAMPLED], 20):
        assert 1e-4 <= p["learning_rate"] <= 0.3 and p["n_estimators"] % 100 == 0


def test_ranking_ties_and_nulls(spark):
    rows = [("t", "a", "m2", 0.5, 1.0), ("t", "a", "m1", 0.5, 2.0), ("t", "a", "m3", None, None)]
    df = spark.createDataFrame(rows, "target string, cohort string, model string, test_r2 double, test_mae double")
    order = lambda by: [r.model for r in compare.rank_models(df, by).orderBy("rank").collect()]
    assert order("r2") == ["m1", "m2", "m3"] and order("mae") == ["m2", "m1", "m3"] and order("whatever") == ["m1", "m2", "m3"]


def test_published_rankings_order(spark):
    """Values of a published results table: ranking by R2 and by MAE, tuned against base."""
    rows = [("efficiency", "EV", "Gradient Boosting", 0.000173, 2043.3520), ("efficiency", "EV", "Tuned Gradient Boosting", -0.000438, 2041.7195),
            ("efficiency", "EV", "Linear Regression", -0.003800, 2032.0094), ("efficiency", "ICE", "Ridge Regression", -0.036251, 5340.8118)]
    df = spark.createDataFrame(rows, "target string, cohort string, model string, test_r2 double, test_mae double")
    assert {(r.cohort, r.model) for r in compare.best_model(df).collect()} == {("EV", "Gradient Boosting"), ("ICE", "Ridge Regression")}
    assert compare.best_model(df, "mae").where("cohort = 'EV'").first().model == "Linear Regression"
    gain = compare.tuned_vs_base(df).first()
    assert gain.mae_gain == pytest.approx(1.6325) and gain.r2_gain == pytest.approx(-0.000611)
    assert compare.most_predictable(df).first().cohort == "EV"


def test_complete_run_on_vehicles(spark, vehicles, tmp_path):
    df = as_cohort_table(vehicles)
    options = runs.RunOptions(models=[registry.OLS, registry.RIDGE, registry.LASSO, registry.TREE], profile="small",
                              cross_validate=False, finetune_search=Search(iterations=2, spaces=registry.FINE_SPACES))
    run = runs.run_target(df, "maintenance_cost_annual", VEHICLES, options)
    best = {r.cohort: r for r in run.best.collect()}
    assert set(best) == {"EV", "ICE"} and all(r.test_r2 > 0.999 for r in best.values())  # the target leaks into its features
    ranks = [r.rank for r in run.rankings.where("cohort = 'EV'").collect()]
    assert sorted(ranks) == list(range(1, len(ranks) + 1))
    runs.save_run(run, str(tmp_path / "run"), VEHICLES)
    summary = spark.read.json(str(tmp_path / "run" / "summary"))
    assert summary.count() == 2 and "best_model" in summary.columns
    report = runs.final_report(run.rankings, run.importances)
    assert report["best"].count() == 2 and report["best_importances"].count() > 0


def test_strict_leakage_removes_the_perfect_fit(spark, vehicles):
    import dataclasses
    strict = dataclasses.replace(VEHICLES, leakage="strict")
    options = runs.RunOptions(models=[registry.OLS], profile="small", cross_validate=False, finetune=0)
    run = runs.run_target(as_cohort_table(vehicles), "maintenance_cost_annual", strict, options)
    assert all(r.test_r2 < 0.5 for r in run.rankings.collect())


def test_older_analysis_uses_plain_columns_and_means(spark):
    """No clamp, filter or selection: the same as least squares by numpy on the original columns, means where missing."""
    from cohortwise.config import ORIGINAL_FEATURES, VEHICLES
    from cohortwise.operators.split import with_split
    from cohortwise.plans.runs import RunOptions, run_plain

    rng = np.random.default_rng(5)
    rows = []
    for i in range(240):
        x = rng.normal(size=7) * 3
        known = [float(v) for v in x]
        if i % 11 == 0:
            known[2] = None
        rows.append((["EV", "Gas"][i % 2], f"{i * 7919:032x}", float(50 + x @ np.arange(1, 8) + rng.normal()), 1.0, *known))
    df = spark.createDataFrame(rows, "cohort string, row_key string, mileage_km double, energy_consumption double, "
                               + ", ".join(f"{n} double" for n in ORIGINAL_FEATURES))
    df = df.withColumn("row_key", F.md5("row_key"))
    got = {r.cohort: r for r in run_plain(df, "efficiency", VEHICLES, RunOptions(models=[registry.OLS], cross_validate=False)).collect()}
    table = with_split(df, "row_key").toPandas()
    for cohort, part in table.groupby("cohort"):
        x = part[list(ORIGINAL_FEATURES)].astype(float)
        x = np.column_stack([x.fillna(x.mean()).to_numpy(), np.ones(len(part))])
        train, y = (part["split"] == "train").to_numpy(), part["mileage_km"].to_numpy()
        w = np.linalg.lstsq(x[train], y[train], rcond=None)[0]
        assert abs(got[cohort].test_mae - np.abs(x[~train] @ w - y[~train]).mean()) < 1e-6
        assert got[cohort].features_used == 7


def test_linear_models_and_void_cohorts_fail_alone(table, monkeypatch):
    from cohortwise.models import linear, train
    void = table.withColumn("v", F.when(F.col("cohort") == "a", F.col("x")))
    data = training_data(void, "y", {"a": ["x", "v"], "b": ["x", "v"]}, VEHICLES)
    trained = train_models(data, [registry.OLS, registry.TREE], cv=False)
    got = {(r.cohort, r.model): (r.status, r.error) for r in trained.results.collect()}
    assert {k: v[0] for k, v in got.items()} == {(c, m): "ok" if c == "a" else "failed" for c in "ab" for m in (registry.OLS, registry.TREE)}
    assert got["b", registry.OLS][1] == "features without any value: v"
    solve = linear.solve

    def broken(sums, out, spec, *rest):
        if spec.name == registry.RIDGE:
            raise np.linalg.LinAlgError("singular")
        return solve(sums, out, spec, *rest)

    monkeypatch.setattr(linear, "solve", broken)
    data = training_data(table, "y", {"a": ["x", "z"], "b": ["x", "z"]}, VEHICLES)
    trained = train_models(data, [registry.OLS, registry.RIDGE], cv=False)
    assert {(r.cohort, r.model): r.status for r in trained.results.collect()} == {
        (c, m): "failed" if m == registry.RIDGE else "ok" for c in "ab" for m in (registry.OLS, registry.RIDGE)}
    assert set(trained.models) == {("a", registry.OLS), ("b", registry.OLS)}
