"""Named queries over the star-schema binding, one or more per operator."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.bounded import attach, collect_bounded, materialize, scratch_dir, small_frame
from cohortwise.models import growth, linear, many, path, registry
from cohortwise.models.train import (
    Search, compare_scalers, finetune_top, linear_scores, multi_metric_search, sequential_trials, train_linear, train_models,
    train_single_features, training_data, results_frame)
from cohortwise.operators import compare, prepare as prep, sketches, stats, transform
from cohortwise.operators.evaluate import predicted_vs_actual, regression_metrics
from cohortwise.operators.features import FEATURES, candidate_names, engineer, feature_column, range_columns, value_ranges
from cohortwise.operators.select import Selection, choose_by_rounds, filled_variance, medians_where_missing, select_features, small_copy
from cohortwise.operators.split import coded, with_split
from cohortwise.operators.tiles import tiled_correlation_pairs
from cohortwise.plans import charts, runs
from cohortwise.plans.runs import RunOptions
from cohortwise.sources import sinks
from cohortwise.sources.tables import UNITS, embedding_units, event_units, part_units, read_table, tables_of, units

C = UNITS.cohort
RATIO = UNITS.ratio_name
MILEAGE, MAINTENANCE = "mileage_km", "maintenance_cost_annual"
FIRST, SECOND = "F", "O"
SCALED = ["torque_Nm", "energy_storage_capacity", "lifespan_years"]


def rounded(column: Column | str, digits: int, name: str | None = None) -> Column:
    """Rounded for comparison across engines; adding zero removes a negative zero."""
    result = F.round(column, digits) + F.lit(0.0)
    return result.alias(name or column) if name or isinstance(column, str) else result


def quickly_rounded(column: Column, digits: int, name: str) -> Column:
    """``rounded`` without Spark's way through a decimal's text, except for values near the middle of two roundings and very large ones."""
    scaled = column * F.lit(10.0 ** digits)
    near = F.rint(scaled)
    clear = (F.abs(scaled) < 1e11) & (F.abs(scaled - near) < 0.4999)
    return F.when(clear, near / F.lit(10.0 ** digits) + F.lit(0.0)).otherwise(rounded(column, digits)).alias(name)


def round_all(df: DataFrame, digits: int, but: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*[rounded(f.name, digits) if f.dataType.typeName() == "double" and f.name not in but else F.col(f.name)
                       for f in df.schema])


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Ratio target from the line table alone."""
    return prep.with_ratio(units(spark, sf, ["mileage_km", "energy_consumption"]), RATIO, *UNITS.components)


def table(spark: SparkSession, sf: str) -> DataFrame:
    """The joined table, written once because every analysis passes over it several times."""
    return materialize(units(spark, sf), "units")


def training_table(spark: SparkSession, sf: str) -> DataFrame:
    """The joined table for training: split, fold and a code in the place of the digest."""
    return materialize(coded(units(spark, sf)), "units")


def prepared(spark: SparkSession, sf: str, target: str) -> DataFrame:
    return runs.prepared_table(table(spark, sf), target, UNITS)


def engineered(spark: SparkSession, sf: str, target: str) -> DataFrame:
    return engineer(prepared(spark, sf, target), target, UNITS)


# --- projections, filters, distributions -----------------------------------

def ratio_target(spark, sf):
    return lines(spark, sf).select(C, "row_key", RATIO)


def clamp_lower(spark, sf):
    column = "co2_emissions_g_per_km"
    return prep.clamp(units(spark, sf, [column]), [column])


def iqr_outliers(spark, sf):
    return prep.remove_outliers(lines(spark, sf), RATIO).select(C, "row_key", RATIO)


def iqr_outliers_any(spark, sf):
    return prep.remove_outliers(event_units(spark, sf), "value")


def iqr_outliers_by_cohort(spark, sf):
    return prep.remove_outliers(event_units(spark, sf), "value", [C])


def iqr_missing_column(spark, sf):
    return prep.remove_outliers(event_units(spark, sf), "no_such_column").groupBy(C).agg(F.count(F.lit(1)).alias("n"))


def sketched_quantiles(spark, sf):
    """Quartiles from stored states of two loads, merged; ``within`` holds them against exact ranks."""
    rows, path = event_units(spark, sf), os.path.join(scratch_dir(spark), f"states-{uuid.uuid4().hex}")
    for load, first in (("first", F.col("row_key") < "8"), ("second", F.col("row_key") >= "8")):
        sketches.store_states(sketches.quantile_states(rows.where(first), ["value"], [C]), path, load)
    found = sketches.state_quantiles(sketches.stored_states(spark, path, [C]), [0.25, 0.5, 0.75], [C])
    found = materialize(found, "sketched")  # a sketch drawn again would give other values
    return sketches.rank_check(rows, found, "value", [C], 3 * sketches.rank_error()).drop("value")


def outlier_accounting(spark, sf):
    return prep.outlier_accounting(lines(spark, sf), RATIO, [C])


def prepared_rows(spark, sf):
    df = prep.prepare(table(spark, sf), RATIO, UNITS)
    return df.select(C, "row_key", *UNITS.originals, RATIO)


def cohort_filter(spark, sf):
    return prep.only_cohort(lines(spark, sf), FIRST, UNITS).drop(C)


def row_preview(spark, sf):
    return lines(spark, sf).orderBy(F.col(RATIO).desc(), "row_key").limit(10)


def cohort_stats(spark, sf):
    return round_all(stats.describe(prep.remove_outliers(lines(spark, sf), RATIO), RATIO, [C]), 6)


def cohort_counts(spark, sf):
    df = units(spark, sf, ["mileage_km"])
    return df.groupBy(C).agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(UNITS.numeric_columns)).alias("n_columns"))


def histogram_density(spark, sf):
    return round_all(stats.histogram(prep.remove_outliers(lines(spark, sf), RATIO), RATIO, C, 30), 9)


def target_distribution(spark, sf):
    return round_all(charts.target_distribution(prep.remove_outliers(lines(spark, sf), RATIO), RATIO, C), 6)


def overlaid_distribution(spark, sf):
    return round_all(charts.overlaid_distribution(prep.remove_outliers(event_units(spark, sf), "value"), "value", C), 6)


def boxplot_stats(spark, sf):
    return round_all(stats.box_plot(event_units(spark, sf), "value", [C]), 6)


def cohort_mean_gap(spark, sf):
    df = units(spark, sf, UNITS.originals)
    return round_all(stats.cohort_mean_gap(df, UNITS.originals, C, FIRST, SECOND), 6)


# --- features ---------------------------------------------------------------

def engineered_features(spark, sf):
    df = engineered(spark, sf, RATIO)
    logs = {f.name for f in FEATURES if f.kind == "log"}
    return df.select("row_key", C, RATIO, *[rounded(f.name, 9) if f.name in logs else F.col(f.name) for f in FEATURES])


def equal_width_bins(spark, sf):
    df = engineered(spark, sf, RATIO)
    codes = stats.stacked(df, ["torque_category_num", "acceleration_category_num"], [C])
    return codes.groupBy(C, "feature", F.col("value").cast("int").alias("code")).agg(F.count(F.lit(1)).alias("n"))


def max_normalised(spark, sf):
    df = units(spark, sf, ["torque_Nm", "cost_per_km", "maintenance_cost_annual"])
    shares = tuple(f for f in FEATURES if f.kind == "share_of_max")
    ranges = value_ranges(df, range_columns(shares), UNITS)
    return attach(df, ranges, [C]).select("row_key", *[feature_column(f, UNITS).alias(f.name) for f in shares])


def _gappy(spark, sf):
    """Rows whose storage ratio misses values where the denominator is zero, and in the other cohort."""
    df = units(spark, sf, ["co2_emissions_g_per_km", "energy_storage_capacity", "torque_Nm"])
    ratio = next(f for f in FEATURES if f.name == "emission_per_storage")
    return df.withColumn(ratio.name, feature_column(ratio, UNITS))


def median_impute(spark, sf):
    df = transform.impute_median(_gappy(spark, sf), ["emission_per_storage", "torque_Nm"], C)
    return df.select("row_key", rounded("emission_per_storage", 6), "torque_Nm")


def mean_impute(spark, sf):
    df = transform.impute_mean(_gappy(spark, sf), ["emission_per_storage", "torque_Nm"], C)
    return df.select("row_key", rounded("emission_per_storage", 4), "torque_Nm")


def missing_counts(spark, sf):
    df = engineered(spark, sf, RATIO)
    return stats.missing_counts(df, candidate_names(None, RATIO, UNITS), [C])


def train_test_split(spark, sf):
    return with_split(units(spark, sf, ["mileage_km"])).select("row_key", "split")


def kfold_assignment(spark, sf):
    return with_split(units(spark, sf, ["mileage_km"])).where("split = 'train'").select("row_key", "fold")


def minmax_scale(spark, sf):
    df = units(spark, sf, SCALED)
    return transform.scale_min_max(df, SCALED, C).select("row_key", *SCALED)


def zscore_scale(spark, sf):
    df = units(spark, sf, SCALED)
    return round_all(transform.scale_standard(df, SCALED, C).select("row_key", *SCALED), 8)


def yeo_johnson_grid(spark, sf):
    df = units(spark, sf, SCALED)
    return round_all(transform.power_likelihoods(df, SCALED, C), 2, ("power",))


def yeo_johnson_best(spark, sf):
    df = units(spark, sf, SCALED)
    return transform.best_powers(transform.power_likelihoods(df, SCALED, C), C)


def onehot_cohort(spark, sf):
    df, names = transform.one_hot(units(spark, sf, ["mileage_km"]), C)
    return df.select("row_key", *[F.col(n).cast("int").alias(n) for n in names])


# --- correlation and selection ----------------------------------------------

def correlation_pairs(spark, sf):
    df = engineered(spark, sf, MILEAGE)
    return round_all(stats.correlation_pairs(df, [*candidate_names(None, MILEAGE, UNITS), MILEAGE], C), 6)


def wide_correlation(spark, sf):
    df = embedding_units(spark, sf)
    return round_all(stats.correlation_pairs(df, [c for c in df.columns if c.startswith("e")], C), 6)


def tiled_correlation(spark, sf):
    """All columns in blocks of 24: six tiles, each a scan of two blocks."""
    df = embedding_units(spark, sf)
    return round_all(tiled_correlation_pairs(df, [c for c in df.columns if c.startswith("e")], C, width=24), 6)


def _correlations(spark, sf, target):
    df = engineered(spark, sf, target)
    pairs = stats.correlation_pairs(df, [*candidate_names(None, target, UNITS), target], C)
    return stats.target_correlations(pairs, target, C)


def target_correlation(spark, sf):
    return round_all(_correlations(spark, sf, MAINTENANCE), 8)


def correlation_bars(spark, sf):
    df = engineered(spark, sf, MAINTENANCE)
    pairs = stats.correlation_pairs(df, [*candidate_names(None, MAINTENANCE, UNITS), MAINTENANCE], C)
    return charts.correlation_bars(pairs, MAINTENANCE, C).drop("corr")


def top_correlations(spark, sf):
    return round_all(charts.most_positive(_correlations(spark, sf, MAINTENANCE).where("corr is not null"), C), 8)


def corr_strength_buckets(spark, sf):
    return stats.strength_buckets(_correlations(spark, sf, MAINTENANCE), C, UNITS.corr_thresholds, UNITS.default_corr_threshold)


def cohort_corr_compare(spark, sf):
    return round_all(stats.compare_cohort_correlations(_correlations(spark, sf, MAINTENANCE), C, FIRST, SECOND), 8)


def corr_lower_triangle(spark, sf):
    df = prep.prepare(table(spark, sf), RATIO, UNITS)
    return round_all(charts.original_correlations(df, RATIO, UNITS), 8)


def variance_filter(spark, sf):
    df = engineered(spark, sf, RATIO)
    names = candidate_names(None, RATIO, UNITS)
    profile = small_copy(stats.profile(df, names, [C]))
    variance = filled_variance(profile, medians_where_missing(df, profile, C), C).where("variance is not null")
    return variance.select(C, "feature", (F.col("variance") > UNITS.variance_threshold).alias("passes"))


def _selection(spark, sf, target) -> Selection:
    return select_features(engineered(spark, sf, target), target, UNITS)


def feature_selection(spark, sf):
    return _selection(spark, sf, MAINTENANCE).table.where("selected").select(C, "feature", "position")


def feature_selection_rounds(spark, sf):
    """The same selection with pruning by rounds of joins, as for tables of many columns."""
    df, names = engineered(spark, sf, MAINTENANCE), candidate_names(None, MAINTENANCE, UNITS)
    profile = small_copy(stats.profile(df, [*names, MAINTENANCE], [C]))
    pairs = materialize(stats.correlation_pairs(df, [*names, MAINTENANCE], C, profile), "pairs")
    found = choose_by_rounds(pairs, profile, small_copy(medians_where_missing(df, profile, C)), MAINTENANCE, UNITS, names)
    return found.table.where("selected").select(C, "feature", "position")


def feature_selection_fallback(spark, sf):
    return _selection(spark, sf, RATIO).table.where("selected").select(C, "feature", "position")


def feature_name_sets(spark, sf):
    names = _correlations(spark, sf, MAINTENANCE).where("corr is not null")
    return compare.feature_name_sets(names, C, FIRST, SECOND)


def feature_summary(spark, sf):
    return charts.feature_summary(_selection(spark, sf, MAINTENANCE).table, UNITS, MAINTENANCE)


# --- linear models ----------------------------------------------------------

def _single(spark, sf, target, features=None, base=None):
    names = features or [n for n in (*UNITS.originals, RATIO) if n != target]
    return _split_by_cohort(_roles_prepared(spark, sf, target, names, base), target, names)


def _roles_prepared(spark, sf, target, names, base=None):
    """Prepared rows with the roles that ``target`` and ``names`` need. Line items alone are scanned again by each
    pass (a few columns); a join is written once, for several targets as ``base``."""
    roles = [*UNITS.components, target, *names]
    if base is None:
        df = units(spark, sf, roles)
        base = df if tables_of(roles) == {"lineitem"} else materialize(coded(df), "units")
    return runs.prepared_table(base, target, UNITS)


def _split_by_cohort(df, target, names):
    cohorts = [r[C] for r in collect_bounded(df.select(C).distinct())]
    return training_data(df, target, {c: list(names) for c in sorted(cohorts)}, UNITS)


def _coefficients(spark, sf, kind, alpha, scaler):
    data = _single(spark, sf, MILEAGE)
    sums = data.sums
    specs = [linear.LinearSpec(f, kind, alpha, scaler, features=(f,)) for f in data.features]
    fits = linear.fit_all(sums, data.chosen, MILEAGE, specs, folds=False)
    data.release()
    rows = [(f.cohort, f.features[0], f.intercept, float(f.coefficients[0])) for f in fits]
    frame = small_frame(spark, rows, "cohort string, feature string, intercept double, slope double")
    return frame.select(C, "feature", rounded("intercept", 4), rounded("slope", 6))


def ols_by_cohort(spark, sf):
    return _coefficients(spark, sf, "ols", 0.0, "none")


def ridge_by_cohort(spark, sf):
    return _coefficients(spark, sf, "ridge", 1.0, "minmax")


def lasso_by_cohort(spark, sf):
    return _coefficients(spark, sf, "lasso", 1.0, "minmax")


def _two_features(spark, sf, kind, alpha, scaler, pooled=False):
    """Mileage on the ratio and the unit cost: coefficients and errors on the test rows."""
    names = [RATIO, "cost_per_km"]
    df = _roles_prepared(spark, sf, MILEAGE, names)
    data = _split_by_cohort(df.withColumn(C, F.lit("pooled")) if pooled else df, MILEAGE, names)
    fits, scores, _ = linear_scores(data, [linear.LinearSpec("two", kind, alpha, scaler)], folds=False)
    rows = []
    for f in fits:
        slope = dict(zip(f.features, map(float, f.coefficients)))
        rows.append((f.cohort, f.intercept, slope[RATIO], slope["cost_per_km"]))
    frame = small_frame(spark, rows, "cohort string, intercept double, slope_ratio double, slope_cost double")
    tested = scores.where("split = 'test'").select(C, F.col("mae").alias("test_mae"), F.col("r2").alias("test_r2"))
    return frame.join(tested, C).select(C, rounded("intercept", 4), rounded("slope_ratio", 6), rounded("slope_cost", 4),
                                        rounded("test_mae", 6), rounded("test_r2", 6))


def ols_two_features(spark, sf):
    return _two_features(spark, sf, "ols", 0.0, "none")


def ridge_two_features(spark, sf):
    return _two_features(spark, sf, "ridge", 1.0, "minmax")


def pooled_ols_two_features(spark, sf):
    return _two_features(spark, sf, "ols", 0.0, "none", pooled=True)


def pooled_ridge_two_features(spark, sf):
    return _two_features(spark, sf, "ridge", 1.0, "minmax", pooled=True)


def _one_model(spark, sf):
    """Least squares of mileage on the ratio: rows with predictions of their cohort's model."""
    data = _single(spark, sf, MILEAGE, [RATIO])
    trained = train_single_features(data)
    return reduce(DataFrame.unionByName, [
        trained.models[c, RATIO].transform(data.rows.where(F.col(C) == c)) for c in sorted(data.chosen)])


def regression_metrics_by_split(spark, sf):
    return round_all(regression_metrics(_one_model(spark, sf), [C, "split"], MILEAGE), 6)


def predicted_vs_actual_rows(spark, sf):
    rows = _one_model(spark, sf).where("split = 'test'")
    return round_all(predicted_vs_actual(rows, ["row_key"], MILEAGE), 4)


def cv_linear_scores(spark, sf):
    data = _single(spark, sf, MILEAGE, [RATIO])
    specs = [linear.LinearSpec("ols", "ols", 0.0, "none")]
    _, scores, _ = linear_scores(data, specs)
    folds = scores.where("stage = 'cv'")
    return round_all(folds.groupBy(C, "model").agg(
        F.count(F.lit(1)).alias("folds"), F.avg("mae").alias("cv_mae_mean"), F.stddev_pop("mae").alias("cv_mae_std"),
        F.avg("r2").alias("cv_r2_mean")), 6)


def alpha_grid_search(spark, sf):
    data = _single(spark, sf, MILEAGE, [RATIO])
    alphas = registry.SEARCH_SPACES[registry.RIDGE]["alpha"]
    specs = [linear.LinearSpec(str(i), "ridge", a, "minmax") for i, a in enumerate(alphas)]
    _, scores, _ = linear_scores(data, specs)
    return scores.where("stage = 'cv'").groupBy(C, F.col("model").cast("int").alias("candidate")).agg(
        rounded(F.avg("mae"), 4, "cv_mae"))


def lasso_grid_search(spark, sf):
    data = _single(spark, sf, MILEAGE, [RATIO])
    alphas = registry.SEARCH_SPACES[registry.LASSO]["alpha"]
    specs = [linear.LinearSpec(str(i), "lasso", a, "minmax") for i, a in enumerate(alphas)]
    _, scores, _ = linear_scores(data, specs)
    return scores.where("stage = 'cv'").groupBy(C, F.col("model").cast("int").alias("candidate")).agg(
        rounded(F.avg("r2"), 8, "cv_r2"))


def part_models(spark, sf):
    """Least squares and ridge for every part as its own cohort, on all rows and with each fold left out."""
    rows = with_split(part_units(spark, sf))
    specs = [linear.LinearSpec("ols", "ols", scaler="none"), linear.LinearSpec("ridge", "ridge", 1.0, "minmax")]
    fits = many.fit_many(rows, "quantity", ["tax", "discount"], C, specs)
    values = {"intercept": F.col("intercept"), "w_tax": F.col("coefficients")[0], "w_discount": F.col("coefficients")[1],
              "train_rmse": F.col("train_rmse"), "train_r2": F.col("train_r2"), "held_rmse": F.col("held_rmse")}
    # Few rows with short decimals give values that lie exactly between two roundings: a small step decides them alike.
    return fits.select(C, "model", "left_out", "n", "held_n", *[quickly_rounded(v + 1e-8, 5, name) for name, v in values.items()])


def _path(spark, sf, kind, names, alphas=None):
    """Mileage on ``names``: every penalty's coefficients and errors, on all training rows and with each fold left out."""
    paths = path.fit_paths(_roles_prepared(spark, sf, MILEAGE, names), MILEAGE, names, C, [kind], alphas)
    weights = {f"w_{name}": F.col("coefficients")[k] for k, name in enumerate(names)}
    return paths.select(C, "step", "left_out", "n", "held_n", rounded("alpha", 6), *[rounded(v, 4, name) for name, v in weights.items()],
                        rounded("intercept", 3), rounded("train_rmse", 4), rounded("held_rmse", 4), rounded("held_r2", 6))


def ridge_path(spark, sf):
    """Three features over 40 penalties."""
    return _path(spark, sf, "ridge", [RATIO, "cost_per_km", "energy_storage_capacity"], [10.0 ** (3 - 7.0 * k / 39) for k in range(40)])


def lasso_path(spark, sf):
    """Two features over each cohort's own 40 penalties."""
    return _path(spark, sf, "lasso", [RATIO, "cost_per_km"])


def penalty_path_best(spark, sf):
    """Every original feature and the ratio: per cohort and kind of path the least error's penalty and the largest one within a standard error."""
    names = [n for n in (*UNITS.originals, RATIO) if n != MILEAGE]
    scores = materialize(path.path_scores(path.fit_paths(_roles_prepared(spark, sf, MILEAGE, names), MILEAGE, names, C)), "path-scores")
    best = [path.best_penalties(scores, errors).withColumn("within_errors", F.lit(errors)) for errors in (0.0, 1.0)]
    return round_all(best[0].unionByName(best[1]), 6, ("within_errors",))


def search_winner(spark, sf):
    """Grid search of both penalties by either metric: the winner, its penalty and its scores."""
    data = _single(spark, sf, MILEAGE, [RATIO])
    parts = []
    for metric in ("mae", "r2"):
        records, _ = train_linear(data, [registry.RIDGE, registry.LASSO], search=Search("grid", metric=metric))
        parts.append(results_frame(spark, records).withColumn("metric", F.lit(metric)))
    data.release()
    return reduce(DataFrame.unionByName, parts).select(
        "metric", "cohort", "model", rounded(F.col("params")["alpha"].cast("double"), 8, "alpha"),
        rounded("tuned_cv_mae_mean", 4), rounded("base_cv_mae_mean", 4), rounded("test_r2", 6))


def pooled_ols(spark, sf):
    result = runs.run_pooled(units(spark, sf, UNITS.components), MILEAGE, UNITS, [RATIO], RunOptions(
        models=[registry.OLS], cross_validate=False))
    return round_all(result.select("train_mae", "train_r2", "test_mae", "test_rmse", "test_r2"), 6)


# --- result tables ----------------------------------------------------------

_METRICS = ["base_cv_mae_mean", "base_cv_mae_std", "train_mae", "train_r2", "test_mae", "test_rmse", "test_r2"]


def _results(spark, sf, targets=(MILEAGE,), tuned=False):
    parts = None
    base_rows = training_table(spark, sf)
    for target in targets:
        data = _single(spark, sf, target, base=base_rows)
        base = train_single_features(data).results
        if tuned:
            base = compare.append_tuned(base, train_single_features(
                data, "ridge", 1000.0, "minmax", lambda f: f"Tuned {f}", "tuned").results)
        data.release()
        parts = base if parts is None else parts.unionByName(base)
    return parts


def feature_models(spark, sf):
    return round_all(_results(spark, sf).select("target", "cohort", "model", *_METRICS), 6)


def model_ranking(spark, sf):
    return compare.rank_models(_results(spark, sf)).select("cohort", "model", "rank")


def model_ranking_by_mae(spark, sf):
    return compare.rank_models(_results(spark, sf), "mae").select("cohort", "model", "rank")


def topk_models(spark, sf):
    return round_all(compare.top_models(_results(spark, sf), 3).select("cohort", "model", "rank", "test_r2"), 6)


def best_models(spark, sf):
    return round_all(compare.best_model(_results(spark, sf)).select("cohort", "model", "test_r2", "test_mae"), 6)


def tuned_vs_base(spark, sf):
    return round_all(compare.tuned_vs_base(_results(spark, sf, tuned=True)), 6)


def append_tuned(spark, sf):
    return round_all(_results(spark, sf, tuned=True).select("cohort", "model", "variant", "test_r2"), 6)


def train_test_gap(spark, sf):
    return round_all(compare.train_test_gap(_results(spark, sf)), 6)


def model_cohort_pivot(spark, sf):
    return round_all(compare.models_by_cohort(_results(spark, sf), FIRST, SECOND), 6)


def cv_stability(spark, sf):
    return round_all(compare.cv_stability(_results(spark, sf), FIRST, SECOND), 6)


def predictable_cohort(spark, sf):
    return round_all(compare.most_predictable(_results(spark, sf, (MILEAGE, MAINTENANCE, RATIO))), 6)


def target_leaderboard(spark, sf):
    return round_all(compare.leaderboard(_results(spark, sf, (MILEAGE, MAINTENANCE, RATIO)), [FIRST, SECOND]), 6)


def _scaler_results(spark, sf):
    """Three penalties and three scalers on one feature, as a scaler comparison table."""
    return compare_scalers(_single(spark, sf, MILEAGE, [RATIO]), (), scalers=linear.SCALERS)


def _penalised(spark, sf):
    return compare.linear_only(_scaler_results(spark, sf), [registry.RIDGE, registry.LASSO])


def scaler_results(spark, sf):
    return round_all(_scaler_results(spark, sf).drop("target", "n_features"), 6)


def scaler_summary(spark, sf):
    return round_all(compare.scaler_summary(_penalised(spark, sf)), 4)


def scaler_means(spark, sf):
    return round_all(compare.group_means(_penalised(spark, sf), ["cohort", "scaler"]), 4)


def scaler_best(spark, sf):
    return round_all(compare.best_rows(_penalised(spark, sf)), 6)


def scaler_ranking(spark, sf):
    return compare.rank_scalers(_penalised(spark, sf)).select("cohort", "scaler", "rank")


def scaler_overall_best(spark, sf):
    return compare.overall_best_scaler(_penalised(spark, sf))


def scaler_pivot(spark, sf):
    return round_all(compare.pivot_scalers(_penalised(spark, sf), "test_r2", [FIRST, SECOND]), 8)


def scaler_details(spark, sf):
    scalers = ["MinMaxScaler", "NoScaling", "StandardScaler"]
    return round_all(compare.pivot_details(_penalised(spark, sf), scalers), 4)


# --- sources and sinks ------------------------------------------------------

def scaler_pivot_file(spark, sf):
    """The pivoted scaler table, written and read back."""
    path = _folder(spark, "scaler-details")
    wide = scaler_details(spark, sf)
    sinks.write_results(wide, path, "csv")
    return sinks.read_results(spark, path, wide.schema, "csv")


def importances_file(spark, sf):
    """Absolute coefficients of the single-feature models, written and read back."""
    path = _folder(spark, "importances")
    data = _single(spark, sf, MILEAGE)
    found = train_single_features(data).importances
    data.release()
    sinks.write_results(found, path, "csv")
    return round_all(sinks.read_results(spark, path, found.schema, "csv"), 6)


def scaler_target_summary(spark, sf):
    """Every scaler with every linear model for all targets, averaged."""
    return runs.overall_scaler_summary(runs.run_scalers(coded(units(spark, sf)), UNITS.targets, UNITS, trees=()))



def _folder(spark: SparkSession, tag: str) -> str:
    return os.path.join(scratch_dir(spark), f"{tag}-{uuid.uuid4().hex}")


def csv_scan(spark, sf):
    path = _folder(spark, "csv")
    df = units(spark, sf, ["mileage_km", "energy_consumption"])
    df.write.option("header", True).csv(path)
    return read_table(spark, path, df.schema)


def cohort_files(spark, sf):
    path = _folder(spark, "cohorts")
    df = lines(spark, sf)
    sinks.write_cohorts(df, path, C)
    return prep.only_cohort(sinks.read_cohorts(spark, path, df.schema), SECOND, UNITS).select(C, "row_key", RATIO)


def rankings_file(spark, sf):
    path = _folder(spark, "rankings")
    ranked = compare.rank_models(_results(spark, sf)).select("target", "cohort", "model", "test_r2", "rank")
    sinks.write_results(ranked, path, "csv")
    return round_all(sinks.best_of(sinks.read_results(spark, path, ranked.schema, "csv")), 6)


def best_of_runs(spark, sf):
    """Three targets as three stored runs; the best model of each target and cohort over all of them."""
    store = sinks.RunStore(spark, _folder(spark, "store"))
    targets = (MILEAGE, MAINTENANCE, RATIO)
    ranked = compare.rank_models(_results(spark, sf, targets))
    for target in targets:
        store.save({"rankings": ranked.where(F.col("target") == target).select("target", "cohort", "model", "test_r2", "test_mae")}, run=target)
    return round_all(store.best().select("target", "cohort", "run", "model", "test_r2", "test_mae"), 6)


def scaler_file(spark, sf):
    path = _folder(spark, "scalers")
    long = _scaler_results(spark, sf).select("cohort", "scaler", "model", "test_mae", "n_samples")
    sinks.write_results(long, path, "csv")
    return round_all(sinks.read_results(spark, path, long.schema, "csv"), 6)


def selected_features_file(spark, sf):
    path = _folder(spark, "selected")
    chosen = sinks.selected_features_table(_selection(spark, sf, MAINTENANCE).table)
    sinks.write_json(chosen, path)
    return sinks.read_json(spark, path, chosen.schema)


# --- tree models, searches and complete runs ---------------------------------

def _training(spark, sf, target=MAINTENANCE):
    return runs.train_from(training_table(spark, sf), target, UNITS)[2]


def _trees(spark, sf, names, cv=True, search=None, profile="full"):
    data = _training(spark, sf)
    results = train_models(data, names, profile, cv=cv, search=search).results
    data.release()
    return results.drop("params")


def decision_tree(spark, sf):
    return _trees(spark, sf, [registry.TREE])


def depth_two_trees(spark, sf):
    """Trees of two levels over eight bins of equal width, on all rows and with each fold left out: their scores."""
    names = [RATIO, "cost_per_km"]
    data = _split_by_cohort(_roles_prepared(spark, sf, MILEAGE, names), MILEAGE, names)
    grower = growth.Grower(data.rows, MILEAGE, C, data.chosen, growth.width_edges)
    grown = grower.grow([growth.Growth(depth=2, bins=8)])
    grower.release()
    data.release()
    rows = [(c, fold, split, *values) for (c, _, fold, split), values in sorted(grown.scores.items())]
    return round_all(small_frame(spark, rows, "cohort string, left_out int, split string, n bigint, mae double, rmse double, r2 double"), 4)


def random_forest(spark, sf):
    """Ten trees of depth 8 without cross-validation; see the README for the full settings."""
    return _trees(spark, sf, [registry.FOREST], cv=False, profile="small")


def boosted_trees(spark, sf):
    return _trees(spark, sf, [registry.BOOSTING])


def boosting_profiles(spark, sf):
    return _trees(spark, sf, [registry.SUBSAMPLED, registry.SLOW, registry.HISTOGRAM])


def linear_models(spark, sf):
    data = _training(spark, sf)
    records, _ = train_linear(data, list(registry.LINEAR_KINDS), search=Search(iterations=10))
    data.release()
    return results_frame(spark, records).drop("params")


def random_search(spark, sf):
    """Thirty candidates of the tree's space, five folds, both cohorts."""
    return _trees(spark, sf, [registry.TREE], search=Search())


def sequential_search(spark, sf):
    """Thirty trials of the tree's ranges, proposed in three batches."""
    data = _training(spark, sf)
    ranges = {"max_depth": ("int", 2, 30), "min_samples_leaf": ("int", 1, 50), "min_samples_split": ("int", 2, 100)}
    trials = sequential_trials(data, registry.tree_models()[registry.TREE], ranges)
    data.release()
    return trials.drop("params")


def loguniform_search(spark, sf):
    """Thirty trials over all the ranges of boosting, proposed in two batches."""
    data = _training(spark, sf)
    trials = sequential_trials(data, registry.tree_models()[registry.BOOSTING], registry.RANGES[registry.BOOSTING], iterations=30, batch=15)
    data.release()
    return trials.drop("params")


def multi_metric_grid(spark, sf):
    """The whole grid of the tree's space by three metrics."""
    data = _training(spark, sf)
    spec = registry.tree_models()[registry.TREE]
    points = Search("grid").spark_candidates(registry.TREE)
    parts = [multi_metric_search(data, c, spec, points) for c in sorted(data.chosen)]
    data.release()
    return reduce(DataFrame.unionByName, parts).drop("params")


def finetune_top2(spark, sf):
    data = _training(spark, sf)
    base = train_models(data, _RUN_MODELS).results
    tuned = finetune_top(data, base)
    data.release()
    return compare.append_tuned(base, tuned.results).drop("params")


def feature_importance(spark, sf):
    data = _training(spark, sf)
    trained = train_models(data, [registry.RIDGE, registry.TREE], cv=False)
    data.release()
    return compare.top_importances(trained.importances)


def scaler_model_grid(spark, sf):
    """Every scaler with every model of the comparison: three linear ones, the forest, boosting and the tree."""
    data = _training(spark, sf)
    rows = compare_scalers(data)
    data.release()
    return rows


_RUN_MODELS = [*registry.LINEAR_KINDS, registry.TREE]


def single_target_run(spark, sf):
    options = RunOptions(models=_RUN_MODELS, search=Search())
    return runs.run_target(training_table(spark, sf), MAINTENANCE, UNITS, options).rankings.drop("params")


def multi_target_run(spark, sf):
    options = RunOptions(models=_RUN_MODELS, finetune=0)
    return runs.union_results(runs.run_targets(coded(units(spark, sf)), UNITS.targets, UNITS, options)).drop("params")


def plain_run(spark, sf):
    return runs.run_plain(training_table(spark, sf), RATIO, UNITS, RunOptions(models=_RUN_MODELS)).drop("params")


def final_report_best(spark, sf):
    options = RunOptions(models=_RUN_MODELS, finetune=0)
    run = runs.run_target(training_table(spark, sf), MILEAGE, UNITS, options)
    return runs.final_report(run.rankings, run.importances)["best_importances"]


def run_summary_json(spark, sf):
    path = _folder(spark, "summary")
    options = RunOptions(models=[registry.OLS, registry.RIDGE], finetune=0)
    run = runs.run_target(training_table(spark, sf), MILEAGE, UNITS, options)
    names = [n for n in candidate_names(None, MILEAGE, UNITS) if n not in UNITS.originals]
    summary = sinks.run_summary(run.results, run.selection, UNITS.originals, names)
    sinks.write_json(summary, path)
    return sinks.read_json(spark, path, summary.schema).select(
        "target", "cohort", "best_model", rounded("best_r2", 6), "n_features", F.to_json("results").alias("results"))


def model_parameters(spark, sf):
    data = _training(spark, sf)
    trained = train_models(data, [registry.RIDGE, registry.TREE], cv=False)
    data.release()
    return sinks.parameters(trained.results)


def model_roundtrip(spark, sf):
    """Save the tree of each cohort, load it and score the test rows with the loaded one."""
    df = engineered(spark, sf, MAINTENANCE)
    selection = select_features(df, MAINTENANCE, UNITS)
    data = training_data(df, MAINTENANCE, selection.chosen, UNITS, selection.fills)
    trained = train_models(data, [registry.TREE], cv=False)
    base = _folder(spark, "models")
    parts = None
    for c in sorted(selection.chosen):
        sinks.save_model(trained.models[c, registry.TREE], base, MAINTENANCE, c)
        scored = sinks.load_model(base, MAINTENANCE, c).transform(data.rows.where((F.col(C) == c) & (F.col("split") == "test")))
        part = scored.select(C, F.col(MAINTENANCE).alias("label"), "prediction")
        parts = part if parts is None else parts.unionByName(part)
    return round_all(regression_metrics(parts, [C]), 6)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    ratio_target, clamp_lower, iqr_outliers, iqr_outliers_any, iqr_outliers_by_cohort, iqr_missing_column, sketched_quantiles,
    outlier_accounting, prepared_rows, cohort_filter, row_preview, cohort_stats, cohort_counts, histogram_density,
    target_distribution, overlaid_distribution, boxplot_stats, cohort_mean_gap, engineered_features, equal_width_bins,
    max_normalised, median_impute, mean_impute, missing_counts, train_test_split, kfold_assignment, minmax_scale,
    zscore_scale, yeo_johnson_grid, yeo_johnson_best, onehot_cohort, correlation_pairs, wide_correlation, tiled_correlation,
    target_correlation, correlation_bars, top_correlations, corr_strength_buckets, cohort_corr_compare,
    corr_lower_triangle, variance_filter, feature_selection, feature_selection_rounds, feature_selection_fallback, feature_name_sets,
    feature_summary, ols_by_cohort, ridge_by_cohort, lasso_by_cohort, ols_two_features, ridge_two_features,
    pooled_ols_two_features, pooled_ridge_two_features, regression_metrics_by_split,
    predicted_vs_actual_rows, cv_linear_scores, part_models, ridge_path, lasso_path, penalty_path_best, alpha_grid_search, lasso_grid_search, search_winner, pooled_ols, feature_models,
    model_ranking, model_ranking_by_mae, topk_models, best_models, tuned_vs_base, append_tuned, train_test_gap,
    model_cohort_pivot, cv_stability, predictable_cohort, target_leaderboard, scaler_results, scaler_summary,
    scaler_means, scaler_best, scaler_ranking, scaler_overall_best, scaler_pivot, scaler_details, scaler_pivot_file,
    importances_file, scaler_target_summary, csv_scan,
    cohort_files, rankings_file, best_of_runs, scaler_file, selected_features_file, decision_tree, depth_two_trees, sequential_search, random_forest, boosted_trees,
    boosting_profiles, linear_models, random_search, loguniform_search, multi_metric_grid, finetune_top2,
    feature_importance, scaler_model_grid, single_target_run, multi_target_run, plain_run, final_report_best,
    run_summary_json, model_parameters, model_roundtrip)}
