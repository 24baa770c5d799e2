import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortwise.models import linear, many, path
from cohortwise.operators.split import with_split
from cohortwise.shipping import ship

NAMES = [f"x{k}" for k in range(8)]


def _rows(spark, n=500):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 8)) @ (np.eye(8) + 0.4 * rng.normal(size=(8, 8)))
    pdf = pd.DataFrame(x, columns=NAMES)
    pdf["x7"] = 2.5
    pdf["y"] = 3 * x[:, 0] - 2 * x[:, 1] + 0.05 * x[:, 2] + rng.normal(0, 1, n) + 50
    pdf.insert(0, "cohort", np.where(np.arange(n) % 3 == 0, "a", "b"))
    pdf["k"] = np.arange(n)
    return with_split(spark.createDataFrame(pdf).withColumn("row_key", F.md5(F.col("k").cast("string"))))


def test_every_step_equals_a_cold_solve(spark):
    ship(spark)
    df = _rows(spark)
    got = path.fit_paths(df, "y", NAMES, "cohort").collect()
    assert {(r.cohort, r.model, r.step, r.left_out) for r in got} == {(c, m, s, o) for c in "ab" for m in ("ridge", "lasso") for s in range(40) for o in range(-1, 5)}
    for kind in ("ridge", "lasso"):
        alphas = {(r.cohort, r.alpha) for r in got if r.model == kind}
        assert len(alphas) == 80
        for c in "ab":
            own = sorted(a for k, a in alphas if k == c)[::13]
            specs = [linear.LinearSpec(repr(a), kind, a) for a in own]
            cold = {(r.model, r.left_out): r for r in many.fit_many(df.where(F.col("cohort") == c), "y", NAMES, "cohort", specs).collect()}
            for r in got:
                if r.model == kind and r.cohort == c and r.alpha in own:
                    want = cold[repr(r.alpha), r.left_out]
                    assert r.coefficients == pytest.approx(want.coefficients, rel=1e-6, abs=1e-8) and r.intercept == pytest.approx(want.intercept, rel=1e-8)
                    assert (r.n, r.held_n) == (want.n, want.held_n) and r.held_rmse == pytest.approx(want.held_rmse, rel=1e-8)
    lasso = [r for r in got if r.model == "lasso" and r.left_out == -1]
    assert all(r.n_active == 0 for r in lasso if r.step == 0) and all(r.coefficients[7] == 0 for r in lasso)
    assert any(r.screened > 2 for r in lasso) and max(r.n_active for r in lasso) > 2


def test_columns_that_the_rule_sets_aside_by_mistake_come_back():
    """Steep jumps between penalties break the rule's premise; correlated columns make it err."""
    rng = np.random.default_rng(0)
    came_back = 0
    for trial in range(60):
        x = rng.normal(size=(30, 12)) @ rng.normal(size=(12, 12))
        gram, moment = x.T @ x / 30, x.T @ rng.normal(size=30) / 30
        top = np.abs(moment).max()
        alphas = np.geomspace(top, top / 50, 12)
        for alpha, (w, _, returned, _) in zip(alphas, path.lasso_path(gram, moment, alphas, 100_000, 1e-4)):
            came_back += returned
            slack = np.abs(moment - gram @ w)
            assert slack.max() <= alpha * (1 + 1e-6) + 1e-9
            assert np.allclose((moment - gram @ w)[w != 0], alpha * np.sign(w[w != 0]), atol=1e-6 * top)
    assert came_back > 0


def test_best_penalties_and_defined_cases(spark):
    ship(spark)
    df = _rows(spark)
    scores = path.path_scores(path.fit_paths(df, "y", NAMES, "cohort", ["lasso"])).persist()
    rows = scores.collect()
    for errors in (0.0, 1.0):
        best = {r.cohort: r for r in path.best_penalties(scores, errors).collect()}
        for c in "ab":
            own = [r for r in rows if r.cohort == c]
            least = min(own, key=lambda r: (r.cv_rmse, r.step))
            assert best[c].alpha == max(r.alpha for r in own if r.cv_rmse <= least.cv_rmse + errors * least.cv_error)
    assert {r.folds for r in rows} == {5}
    given = path.fit_paths(df, "y", NAMES, "cohort", ["ridge"], alphas=[0.0, 5.0, 5.0], folds=[]).collect()
    assert sorted((r.cohort, r.step, r.alpha) for r in given) == [(c, s, a) for c in "ab" for s, a in ((0, 5.0), (1, 0.0))]
    assert path.best_penalties(path.path_scores(path.fit_paths(df, "y", NAMES, "cohort", ["ridge"], folds=[]))).count() == 0
    flat = path.fit_paths(df.withColumn("y", F.lit(3.0)), "y", NAMES, "cohort", ["lasso"]).collect()
    assert {(r.step, r.alpha, r.n_active, r.train_r2) for r in flat} == {(0, 0.0, 0, None)}
    assert path.fit_paths(df.limit(0), "y", NAMES, "cohort").count() == 0
    assert path.fit_paths(df.withColumn("x0", F.lit(None).cast("double")), "y", NAMES, "cohort").count() == 0
    for bad in ([-1.0], [], [float("nan")]):
        with pytest.raises(ValueError):
            path.fit_paths(df, "y", NAMES, "cohort", alphas=bad)
    scores.unpersist()
