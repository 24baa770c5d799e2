import dataclasses

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortwise import VEHICLES
from cohortwise.bounded import TooManyRows, attach, collect_bounded, small_frame
from cohortwise.functions.columns import yeo_johnson
from cohortwise.operators import features, prepare, quantiles, select, split, stats, transform
from cohortwise.sources.tables import as_cohort_table, read_table


@pytest.mark.parametrize("limit,bins", [(1_000_000, 10_000), (5, 10)])
def test_quantiles_equal_numpy_for_any_size_and_narrowing(spark, monkeypatch, limit, bins):
    monkeypatch.setattr(quantiles, "MAX_ORDERED_VALUES", limit)
    monkeypatch.setattr(quantiles, "BINS", bins)
    rng = np.random.default_rng(3)
    groups = {"one": rng.normal(size=1), "two": rng.normal(size=2), "odd": rng.normal(size=203),
              "wide": np.r_[rng.normal(size=300) * 10.0 ** rng.integers(-200, 200, 300), -1e300, 1.7e308, -1.7e308, 0.0],
              "ties": rng.integers(0, 4, 500).astype(float), "hot": np.r_[np.full(400, 5.0), rng.normal(size=800)]}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("two", None), ("void", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {(r.g, r.p): r.value for r in quantiles.quantiles(df, ["x"], [0.0, 0.25, 0.5, 0.99, 1.0], ["g"]).collect()}
    assert got["void", 0.5] is None
    for (g, p), value in got.items():
        if g != "void":
            assert value == pytest.approx(np.quantile(groups[g], p), rel=1e-12, abs=1e-12), (g, p)


def test_outlier_fences_are_closed_and_drop_null(spark):
    df = spark.createDataFrame([(float(v),) for v in [*range(1, 21), 1000]] + [(None,)], "x double")
    kept = sorted(r.x for r in prepare.remove_outliers(df, "x").collect())
    assert kept == [float(v) for v in range(1, 21)]
    assert prepare.remove_outliers(df, "absent").count() == 22


def test_outliers_by_cohort_use_each_cohorts_fences(spark):
    rows = [("a", float(v)) for v in range(10)] + [("b", float(1000 + v)) for v in range(10)] + [("a", 500.0)]
    df = spark.createDataFrame(rows, "cohort string, x double")
    kept = prepare.remove_outliers(df, "x", ["cohort"])
    assert kept.where("x = 500").count() == 0 and kept.count() == 20


def test_prepared_vehicles(spark, vehicles):
    df = as_cohort_table(vehicles)
    ready = prepare.prepare(df, "efficiency", VEHICLES)
    assert ready.where("co2_emissions_g_per_km < 0").count() == 0
    pdf = vehicles.toPandas()
    ratio = pdf.mileage_km / pdf.energy_consumption
    q1, q3 = ratio.quantile(0.25), ratio.quantile(0.75)
    assert ready.count() == ratio.between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)).sum()


def test_engineered_features_match_pandas(spark, vehicles):
    df = features.engineer(prepare.with_ratio(as_cohort_table(vehicles), "efficiency", "mileage_km", "energy_consumption"),
                           "efficiency", VEHICLES)
    assert "mileage_km" not in df.columns and "energy_consumption" not in df.columns
    got = df.toPandas()
    for cohort, part in got.groupby("cohort"):
        codes = pd.cut(part.torque_Nm, bins=5, labels=False)
        assert (codes == part.torque_category_num).all()
        assert np.allclose(part.normalized_cost, part.cost_per_km / part.cost_per_km.max())
        assert np.allclose(part.log_torque, np.log1p(part.torque_Nm))
        assert part.eco_efficiency.notna().all() == (cohort == "EV")
        assert part.emission_intensity.notna().all() == (cohort == "ICE")
    assert len(features.engineered_names(None, "efficiency", VEHICLES)) == 24
    assert len(features.engineered_names("EV", "mileage_km", VEHICLES)) == 23


def test_strict_leakage_drops_features_derived_from_the_target():
    strict = dataclasses.replace(VEHICLES, leakage="strict")
    names = features.candidate_names("EV", "maintenance_cost_annual", strict)
    assert not {n for n in names if "maintenance" in n}
    assert "efficiency" not in features.candidate_names("EV", "mileage_km", strict)
    assert "efficiency" in features.candidate_names("EV", "mileage_km", VEHICLES)


def test_split_and_folds_do_not_depend_on_partitioning(spark, vehicles):
    df = as_cohort_table(vehicles)
    one = {r.row_key: (r.split, r.fold) for r in split.with_split(df.repartition(1)).collect()}
    many = {r.row_key: (r.split, r.fold) for r in split.with_split(df.repartition(16)).collect()}
    assert one == many and {s for s, _ in one.values()} == {"train", "test"} and {f for _, f in one.values()} == set(range(5))


def test_correlations_match_pandas_with_missing_and_constant_columns(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"cohort": ["a", "b"] * 100, "x": rng.normal(1e6, 1, 200), "y": rng.normal(size=200)})
    pdf["z"] = pdf.x * 2 + pdf.y
    pdf["flat"] = 0.1
    pdf.loc[::7, "y"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    got = {(r.cohort, r.a, r.b): (r.n, r["corr"]) for r in stats.correlation_pairs(df, ["x", "y", "z", "flat"], "cohort").collect()}
    for cohort, part in pdf.groupby("cohort"):
        for a, b in (("x", "y"), ("x", "z"), ("y", "z")):
            assert got[cohort, a, b][1] == pytest.approx(part[a].corr(part[b]), abs=1e-9)
        assert got[cohort, "x", "flat"][1] is None
        assert got[cohort, "x", "y"][0] == part.y.notna().sum()


def test_variance_after_filling_matches_numpy(spark):
    pdf = pd.DataFrame({"cohort": "a", "x": [1.0, 2.0, 4.0, np.nan, 9.0]})
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    profile = stats.profile(df, ["x"], ["cohort"])
    row = select.filled_variance(profile, select.medians_where_missing(df, profile, "cohort"), "cohort").first()
    assert row.variance == pytest.approx(np.var([1.0, 2.0, 4.0, 3.0, 9.0]))


def test_greedy_prune():
    r = {("b", "a"): 0.9, ("c", "a"): -0.3, ("c", "b"): 0.99, ("d", "a"): None, ("d", "c"): -0.86}
    assert select.greedy_prune(["a", "b", "c", "d"], r, 0.85, 20) == ["a", "c"]
    assert select.greedy_prune(["a", "b", "c"], r, 0.85, 1) == ["a"]
    assert select.greedy_prune([], r, 0.85, 20) == []


def _noise(spark, weak=0.0, columns=30, n=400):
    rng = np.random.default_rng(11)
    y = rng.normal(size=n)
    pdf = pd.DataFrame({f"f{i:02d}": rng.normal(size=n) + weak * y for i in range(columns)})
    return spark.createDataFrame(pdf.assign(cohort="a", y=y))


def test_selection_caps_and_falls_back(spark):
    names = [f"f{i:02d}" for i in range(30)]
    many = select.select_features(_noise(spark, 0.7), "y", VEHICLES, names)
    assert len(many.chosen["a"]) == VEHICLES.max_features
    blocked = dataclasses.replace(VEHICLES, default_corr_threshold=0.99)
    none = select.select_features(_noise(spark), "y", blocked, names)
    assert none.chosen["a"] == names and none.table.first().fallback


def test_selected_pairs_stay_below_the_collinearity_limit(spark, vehicles):
    df = split.with_split(prepare.prepare(as_cohort_table(vehicles), "mileage_km", VEHICLES))
    chosen = select.select_features(features.engineer(df, "mileage_km", VEHICLES), "mileage_km", VEHICLES)
    assert "efficiency" in chosen.chosen["EV"]
    for r in chosen.pairs.collect():
        if r.a in chosen.chosen[r.cohort] and r.b in chosen.chosen[r.cohort]:
            assert abs(r["corr"]) < VEHICLES.collinearity_threshold


def test_imputation_and_scaling(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 5.0), ("b", 7.0)], "cohort string, x double")
    assert sorted(r.x for r in transform.impute_median(df, ["x"], "cohort").collect()) == [1.0, 3.0, 5.0, 7.0]
    assert sorted(r.x for r in transform.impute_mean(df, ["x"], "cohort").collect()) == [1.0, 3.0, 5.0, 7.0]
    assert sorted(r.x for r in transform.scale_min_max(df.dropna(), ["x"], "cohort").collect()) == [0.0, 0.0, 1.0]


def test_power_transform_straightens_a_skewed_column(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame(pd.DataFrame({"cohort": "a", "x": np.expm1(rng.normal(2, 0.5, 800))}))
    power = transform.fit_powers(df, ["x"], "cohort").first().power
    assert abs(power) < 0.15
    out = transform.power_transform(df, ["x"], "cohort").toPandas().x
    assert abs(out.mean()) < 1e-9 and out.std(ddof=0) == pytest.approx(1.0) and abs(out.skew()) < 0.2


def test_one_hot(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "cohort string, k int")
    hot, names = transform.one_hot(df, "cohort")
    assert names == ["is_a", "is_b"] and {(r.k, r.is_a, r.is_b) for r in hot.collect()} == {(1, 1.0, 0.0), (2, 0.0, 1.0)}


def test_bounds_are_checked_not_truncated(spark):
    with pytest.raises(TooManyRows):
        collect_bounded(spark.range(11), 10)


def test_attach_without_broadcast_gives_the_same_rows(spark, monkeypatch):
    df = spark.range(50).withColumn("g", F.col("id") % 5)
    means = df.groupBy("g").agg(F.avg("id").alias("m"))
    small = sorted(map(tuple, attach(df, means, ["g"]).collect()))
    monkeypatch.setattr("cohortwise.bounded.MAX_BROADCAST_ROWS", 2)
    assert sorted(map(tuple, attach(df, means, ["g"]).collect())) == small


def test_small_frame_round_trip(spark):
    rows = [("a", 1, 2.5, {"k": "v"}, True), (None, None, None, None, None)]
    frame = small_frame(spark, rows, "s string, i int, d double, m map<string,string>, b boolean")
    assert [tuple(r) for r in frame.collect()] == rows


def test_csv_columns_are_read_by_name(spark, vehicles, tmp_path):
    path = str(tmp_path / "vehicles")
    vehicles.select(*reversed(vehicles.columns)).write.option("header", True).csv(path)
    back = read_table(spark, path)
    assert back.schema["torque_Nm"].dataType.simpleString() == "double"
    assert back.agg(F.sum("torque_Nm")).first()[0] == pytest.approx(vehicles.agg(F.sum("torque_Nm")).first()[0])


def test_box_plot_and_histogram(spark):
    values = [float(v) for v in [1, 2, 3, 4, 5, 6, 7, 8, 9, 100]]
    df = spark.createDataFrame([("a", v) for v in values], "cohort string, x double")
    box = stats.box_plot(df, "x", ["cohort"]).first()
    assert (box.q1, box.median, box.q3) == tuple(np.quantile(values, [0.25, 0.5, 0.75]))
    assert (box.whisker_low, box.whisker_high, box.n_outliers) == (1.0, 9.0, 1)
    counts = {r.bin: r.n for r in stats.histogram(df, "x", "cohort", 10).collect()}
    assert counts == {k: {0: 9, 9: 1}.get(k, 0) for k in range(10)}


def test_histogram_of_a_constant_column_has_width(spark):
    df = spark.createDataFrame([("a", 5.0), ("a", 5.0), ("a", None), ("a", float("nan")), (None, 7.0)], "cohort string, x double")
    rows = {r.bin: r for r in stats.histogram(df, "x", "cohort", 30).collect()}
    counts, edges = np.histogram([5.0, 5.0], 30)
    assert [rows[k].n for k in range(30)] == counts.tolist() and rows[0].low == edges[0] and rows[29].high == pytest.approx(edges[30])
    assert rows[15].density == pytest.approx(30.0)


def test_dense_values_are_ordered_after_one_count(spark, monkeypatch):
    """Values within a power of ten: the first count leaves few enough to order."""
    monkeypatch.setattr(quantiles, "MAX_ORDERED_VALUES", 400)
    kinds, plain = [], quantiles._count_inside

    def counted(df, by, lookup, ranks, ordered):
        kinds.append(ordered)
        return plain(df, by, lookup, ranks, ordered)

    monkeypatch.setattr(quantiles, "_count_inside", counted)
    values = np.random.default_rng(5).uniform(900, 2000, 20_000)
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = [r.value for r in quantiles.quantiles(df, ["x"], [0.25, 0.5]).orderBy("p").collect()]
    assert got == pytest.approx(np.quantile(values, [0.25, 0.5]).tolist(), rel=1e-12)
    assert kinds == [True]


def test_quantiles_with_nan_and_infinities(spark):
    groups = {"nan": [1.0, 2.0, 3.0, float("nan")], "up": [1.0, 2.0, float("inf"), float("inf")], "down": [float("-inf"), 1.0, 2.0, 3.0],
              "ends": [float("-inf"), float("inf")]}
    df = spark.createDataFrame([(g, v) for g, values in groups.items() for v in values], "g string, x double")
    got = {(r.g, r.p): (r.n, r.value) for r in quantiles.quantiles(df, ["x"], [0.0, 0.5, 0.9, 1.0], ["g"]).collect()}
    assert got["nan", 0.9] == (3, pytest.approx(2.8))
    assert [got["up", p][1] for p in (0.0, 0.5, 1.0)] == [1.0, float("inf"), float("inf")]
    assert got["down", 0.0][1] == float("-inf") and got["down", 0.5][1] == 1.5 and got["down", 1.0][1] == 3.0
    assert got["ends", 0.5][1] is None and got["ends", 1.0][1] == float("inf")


def test_powers_beyond_the_first_grid_are_found(spark):
    rng = np.random.default_rng(4)
    z = rng.normal(0.2, 0.005, 600)
    pdf = pd.DataFrame({"cohort": "a", "x": (1 - 4 * z) ** -0.25 - 1, "flat": 3.0})
    found = {r.feature: r.power for r in transform.fit_powers(spark.createDataFrame(pdf), ["x", "flat"], "cohort").collect()}

    def loglik(power):
        bent = ((pdf.x + 1) ** power - 1) / power
        return -len(pdf) / 2 * np.log(bent.var(ddof=0)) + (power - 1) * np.log1p(pdf.x).sum()
    best = max(np.arange(-20, -0.01, 0.025), key=loglik)
    assert found["flat"] == 1.0 and found["x"] < -2.25 and abs(found["x"] - best) <= 0.06


def test_scratch_folder_follows_the_session(spark):
    from types import SimpleNamespace

    from cohortwise.bounded import scratch_dir

    def session(settings):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: settings.get(key, default)),
                               sparkContext=SimpleNamespace(applicationId="app-1"))

    assert scratch_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_dir(session({"spark.checkpoint.dir": "s3://shared/x", "spark.master": "yarn"})) == "s3://shared/x"
    local = session({"spark.master": "local[2]"})
    assert scratch_dir(local) == scratch_dir(local)
    with pytest.raises(ValueError):
        scratch_dir(session({"spark.master": "yarn"}))


def test_rows_without_a_cohort_do_not_enter_correlations(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 3.5), ("a", 3.0, 7.0), (None, 9.0, -9.0)], "cohort string, x double, y double")
    rows = stats.correlation_pairs(df, ["x", "y"], "cohort").collect()
    assert [(r.cohort, r.n) for r in rows] == [("a", 3)]


def test_pair_sums_agree_with_and_without_missing_values():
    z = np.random.default_rng(1).normal(size=(50, 4))
    for a, b in zip(stats._complete_sums(z), stats._pairwise_sums(z)):
        assert np.allclose(a, b)


def test_power_likelihoods_equal_plain_aggregates_on_odd_values(spark):
    """Gaps, infinities, constants, both signs and a missing cohort: as one aggregate per power, with no row per value and power."""
    rng = np.random.default_rng(5)
    rows = [(["a", "b", None][i % 3], float(rng.normal(5, 100)) if i % 5 else None, 1.0 * i if i != 6 else float("inf"), 3.25, None if i else float("nan")) for i in range(200)]
    df = spark.createDataFrame(rows, "cohort string, x double, z double, c double, m double").repartition(4)
    powers = (-2.0, 0.0, 0.3, 2.0)
    found = transform.power_likelihoods(df, ["x", "z", "c", "m"], "cohort", powers)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.cohort, r.feature, r.power): r.loglik for r in found.collect()}
    assert len(got) == 3 * 4 * len(powers)
    for name in ("x", "z", "c", "m"):
        for p in powers:
            bent = yeo_johnson(F.col(name), p)
            for r in df.groupBy("cohort").agg(F.count(name).alias("n"), F.var_pop(bent).alias("v"), F.sum(F.signum(name) * F.log1p(F.abs(name))).alias("s")).collect():
                sound = name != "c" and r.v is not None and 0 < r.v < float("inf")
                want = -r.n / 2 * np.log(r.v) + (p - 1) * r.s if sound else None
                assert got[r.cohort, name, p] == (None if want is None else pytest.approx(want, rel=1e-9)), (r.cohort, name, p)


def test_moments_and_pairs_from_one_pass(spark, monkeypatch):
    rng = np.random.default_rng(5)
    n = 900
    x = 1e9 + rng.normal(size=n)
    pdf = pd.DataFrame({"cohort": np.where(np.arange(n) % 3 == 0, "a", "b"), "x": x, "y": (x - 1e9) * 2 + rng.normal(size=n),
                        "gaps": np.where(rng.random(n) < 0.3, np.nan, rng.normal(size=n)), "flat": 0.1, "void": np.nan})
    pdf.loc[pdf.cohort == "b", "flat"] = 0.3
    names = ["x", "y", "gaps", "flat", "void"]
    df = spark.createDataFrame(pdf).select("cohort", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in names]).repartition(7)
    found = stats.moments_and_pairs(df, names, "cohort").cache()
    got = {(r.cohort, r.feature): r for r in stats.profile_of(found, "cohort").collect()}
    for r in stats.profile(df, names, ["cohort"]).collect():
        mine = got[r.cohort, r.feature]
        assert (mine.n_rows, mine.n, mine.minimum, mine.maximum) == (r.n_rows, r.n, r.minimum, r.maximum)
        assert mine["mean"] == (None if r["mean"] is None else pytest.approx(r["mean"], rel=1e-12))
        assert mine.var_pop == (None if r.var_pop is None else pytest.approx(r.var_pop, rel=1e-6, abs=1e-20))
    pairs = {(r.cohort, r.a, r.b): r["corr"] for r in stats.pairs_of(found, "cohort").collect()}
    for c, part in pdf.groupby("cohort"):
        for a, b in (("x", "y"), ("x", "gaps")):
            assert pairs[c, a, b] == pytest.approx(part[a].corr(part[b]), abs=1e-9)
        assert pairs[c, "x", "flat"] is None and pairs[c, "x", "void"] is None
    assert len(pairs) == 2 * 10
    monkeypatch.setattr(select, "profile", None)  # a selection makes no pass for moments alone
    chosen = select.select_features(df, "y", VEHICLES, features=["x", "gaps", "flat"]).chosen
    assert all(names[0] == "x" and "flat" not in names for names in chosen.values()) and set(chosen) == {"a", "b"}

