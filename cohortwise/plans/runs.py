"""Complete analyses: one target, several targets, scalers, pooled model."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.bounded import collect_bounded, materialize
from cohortwise.config import CohortConfig
from cohortwise.models import registry
from cohortwise.models.train import (
    Search, TrainingData, compare_scalers, finetune_top, train_models, training_data)
from cohortwise.operators import compare
from cohortwise.operators.features import candidate_names, engineer
from cohortwise.operators.prepare import clamp, prepare, with_ratio
from cohortwise.operators.select import Selection, select_features, small_copy
from cohortwise.operators.split import ensure_split
from cohortwise.operators.stats import profile
from cohortwise.operators.transform import one_hot
from cohortwise.sources import sinks


@dataclass(frozen=True)
class RunOptions:
    rank_by: str = "r2"
    models: Sequence[str] | None = None
    profile: str = "full"
    cross_validate: bool = True
    search: Search | None = None
    finetune: int = 2
    finetune_search: Search | None = None
    scaler: str = "minmax"
    exact_quantiles: bool = True
    remove_outliers: bool = True
    parallelism: int = 4


@dataclass
class RunResult:
    prepared: DataFrame
    engineered: DataFrame
    selection: DataFrame
    correlations: DataFrame
    results: DataFrame
    rankings: DataFrame
    importances: DataFrame
    models: dict[tuple[str, str, str], PipelineModel] = field(default_factory=dict)

    @property
    def best(self) -> DataFrame:
        return self.rankings.where("rank = 1")


def prepared_table(df: DataFrame, target: str, config: CohortConfig, options: RunOptions = RunOptions()) -> DataFrame:
    if options.remove_outliers:
        ready = prepare(df, target, config, options.exact_quantiles)
    else:
        ready = clamp(with_ratio(df, config.ratio_name, config.ratio_numerator, config.ratio_denominator), config.clamped)
    return ensure_split(ready, config.row_key)


def train_from(df: DataFrame, target: str, config: CohortConfig,
               options: RunOptions = RunOptions()) -> tuple[DataFrame, Selection, TrainingData]:
    """Prepare, engineer and select: what every kind of training starts from."""
    engineered = engineer(prepared_table(df, target, config, options), target, config)
    selection = select_features(engineered, target, config)
    return engineered, selection, training_data(engineered, target, selection.chosen, config, selection.fills)


def run_target(df: DataFrame, target: str, config: CohortConfig, options: RunOptions = RunOptions()) -> RunResult:
    """Prepare, engineer, select, train, fine-tune and rank for one target."""
    prepared = prepared_table(df, target, config, options)
    engineered = engineer(prepared, target, config)
    selection = select_features(engineered, target, config)
    data = training_data(engineered, target, selection.chosen, config, selection.fills)
    trained = train_models(data, options.models, options.profile, options.cross_validate, options.search,
                           options.scaler, options.parallelism)
    results, importances, models = trained.results, trained.importances, dict(trained.models)
    if options.finetune:
        tuned = finetune_top(data, results, options.finetune, options.rank_by, options.finetune_search,
                             options.profile, options.parallelism)
        results = compare.append_tuned(results, tuned.results)
        importances = importances.unionByName(tuned.importances)
        models |= tuned.models
    data.release()
    return RunResult(prepared, engineered, selection.table.withColumn("target", F.lit(target)),
                     selection.pairs.withColumn("target", F.lit(target)), results,
                     compare.rank_models(results, options.rank_by), importances,
                     {(target, *key): model for key, model in models.items()})


def run_targets(df: DataFrame, targets: Sequence[str], config: CohortConfig, options: RunOptions = RunOptions(),
                keep_input: bool = True) -> dict[str, RunResult]:
    """The same for several targets. The input is written once; each target filters its own outliers."""
    base = materialize(df, "base") if keep_input else df
    return {target: run_target(base, target, config, options) for target in targets}


def union_results(runs: dict[str, RunResult], part: str = "rankings") -> DataFrame:
    return reduce(DataFrame.unionByName, [getattr(r, part) for r in runs.values()])


def save_run(run: RunResult, path: str, config: CohortConfig) -> None:
    """Rankings, selection, parameters, nested summary and the best model of every cohort, as single files in one folder."""
    sinks.write_results(run.rankings, f"{path}/rankings")
    sinks.write_json(sinks.selected_features_table(run.selection), f"{path}/selected_features")
    sinks.write_json(sinks.parameters(run.results), f"{path}/parameters")
    sinks.write_results(compare.top_importances(run.importances), f"{path}/importances", "csv")
    sinks.write_json(_summary(run, config), f"{path}/summary")
    _save_best(run, f"{path}/models")


def store_run(run: RunResult, store: sinks.RunStore, config: CohortConfig, name: str | None = None) -> str:
    """The same tables and models as one run of a store: readers see all of it or nothing."""
    tables = {"rankings": run.rankings, "selected_features": sinks.selected_features_table(run.selection), "parameters": sinks.parameters(run.results),
              "importances": compare.top_importances(run.importances), "summary": _summary(run, config)}
    return store.save(tables, lambda folder: _save_best(run, folder), name)


def _summary(run: RunResult, config: CohortConfig) -> DataFrame:
    target = next(iter(run.models))[0] if run.models else config.ratio_name
    names = [n for n in candidate_names(None, target, config) if n not in config.originals]
    return sinks.run_summary(run.results, run.selection, config.originals, names)


def _save_best(run: RunResult, folder: str) -> None:
    for r in collect_bounded(run.best.select("target", "cohort", "model")):
        model = run.models.get((r.target, r.cohort, r.model))
        if model is not None:
            sinks.save_model(model, folder, r.target, r.cohort)


def final_report(rankings: DataFrame, importances: DataFrame, k: int = 5) -> dict[str, DataFrame]:
    """Tables of the closing report: best models, top k, tuned against base, parameters."""
    best = rankings.where("rank = 1")
    keys = ["target", "cohort", "model"]
    return {
        "best": best.select(*keys, "test_r2", "test_mae", "test_rmse"),
        "top": rankings.where(F.col("rank") <= k),
        "tuned_vs_base": compare.tuned_vs_base(rankings),
        "best_parameters": sinks.parameters(best),
        "best_importances": compare.top_importances(importances).join(best.select(*keys), keys, "left_semi"),
    }


def run_scalers(df: DataFrame, targets: Sequence[str], config: CohortConfig, options: RunOptions = RunOptions(),
                trees: Sequence[str] = (registry.FOREST, registry.BOOSTING, registry.TREE)) -> DataFrame:
    """Scaler by model by cohort, for several targets."""
    base = materialize(df, "base")
    parts = []
    for target in targets:
        _, _, data = train_from(base, target, config, options)
        parts.append(compare_scalers(data, trees, options.profile, options.parallelism))
        data.release()
    return reduce(DataFrame.unionByName, parts)


def overall_scaler_summary(results: DataFrame) -> DataFrame:
    """Per target: linear models' mean R2 and MAE by scaler."""
    return compare.group_means(compare.linear_only(results), ["target", "cohort", "scaler"])


def run_plain(df: DataFrame, target: str, config: CohortConfig, options: RunOptions = RunOptions()) -> DataFrame:
    """The older analysis: the original columns as they are, means for missing values, z-scores, ranked by MAE.

    No clamp, outlier filter, engineered features, selection or fine-tuning.
    """
    ready = ensure_split(with_ratio(df, config.ratio_name, config.ratio_numerator, config.ratio_denominator), config.row_key)
    names = [n for n in config.originals if n != target]
    means = small_copy(profile(ready, names, [config.cohort]).select(config.cohort, "feature", F.col("mean").alias("value")))
    cohorts = sorted({r[config.cohort] for r in collect_bounded(means)})
    data = training_data(ready, target, {c: names for c in cohorts}, config, means)
    trained = train_models(data, options.models, options.profile, options.cross_validate, None, "standard", options.parallelism)
    data.release()
    return compare.rank_models(trained.results, "mae")


def run_pooled(df: DataFrame, target: str, config: CohortConfig, features: Sequence[str],
               options: RunOptions = RunOptions()) -> DataFrame:
    """One model over all cohorts, the cohort entering as one-hot columns."""
    prepared = prepared_table(df, target, config, options)
    hot, names = one_hot(prepared, config.cohort)
    pooled = hot.withColumn(config.cohort, F.lit("pooled"))
    data = training_data(pooled, target, {"pooled": [*features, *names]}, config)
    trained = train_models(data, options.models, options.profile, options.cross_validate, options.search,
                           options.scaler, options.parallelism)
    data.release()
    return trained.results
