"""Catalog queries do the whole job."""

from cohortwise.models import registry
from cohortwise.plans import catalog


def test_finetune_takes_the_two_best_of_all_models(spark):
    rows = catalog.finetune_top2(spark, "/root/testdata/sf0.001").collect()
    for cohort in {r.cohort for r in rows}:
        own = [r for r in rows if r.cohort == cohort]
        base = sorted((r for r in own if not r.model.startswith("Tuned ")), key=lambda r: (-r.test_r2, r.model))
        assert {r.model for r in base} >= set(registry.LINEAR_KINDS)
        assert {r.model for r in own if r.model.startswith("Tuned ")} == {f"Tuned {r.model}" for r in base[:2]}, cohort


def test_loguniform_search_searches_every_range_of_boosting(spark, monkeypatch):
    asked = []
    trials = spark.createDataFrame([("a", 1)], "cohort string, params int")
    data = type("Data", (), {"release": lambda self: None})()
    monkeypatch.setattr(catalog, "_training", lambda spark, sf: data)
    monkeypatch.setattr(catalog, "sequential_trials", lambda data, spec, ranges, **options: asked.append((spec, ranges, options)) or trials)
    catalog.loguniform_search(spark, "")
    spec, ranges, options = asked[0]
    assert ranges == registry.RANGES[registry.BOOSTING] and "n_estimators" in ranges and options["iterations"] == 30
    assert spec == registry.tree_models()[registry.BOOSTING]


def test_scaler_model_grid_has_the_forest(spark, monkeypatch):
    """Four scalers with six models for each cohort; forests have all trees of the full profile."""
    full = registry.compared_models()[registry.FOREST]
    assert full.growth.bagged and (full.growth.rounds, full.growth.depth) == (200, 30)
    small = registry.compared_models("small")
    monkeypatch.setattr(registry, "compared_models", lambda profile: small)
    rows = catalog.scaler_model_grid(spark, "/root/testdata/sf0.001").collect()
    models = {*registry.LINEAR_KINDS, registry.FOREST, registry.BOOSTING, registry.TREE}
    for cohort in {r.cohort for r in rows}:
        own = [r for r in rows if r.cohort == cohort]
        assert {(r.scaler, r.model) for r in own} == {(s, m) for s in ("PowerTransformer", "MinMaxScaler", "StandardScaler", "NoScaling") for m in models} and len(own) == 24
        assert all(r.test_mae > 0 and r.cv_mae_mean > 0 for r in own)
