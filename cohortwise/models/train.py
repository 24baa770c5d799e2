"""Training, cross-validation, search and fine-tuning for every cohort."""

from __future__ import annotations

import statistics
import threading
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.bounded import collect_bounded, small_frame
from cohortwise.config import CohortConfig
from cohortwise.models import growth, linear, registry, sampler
from cohortwise.operators.evaluate import metric_columns
from cohortwise.operators.split import CODE
from cohortwise.operators.stats import medians
from cohortwise.operators.transform import fill, power_transform

RESULT_SCHEMA = (
    "target string, cohort string, model string, variant string, "
    "base_cv_mae_mean double, base_cv_mae_std double, tuned_cv_mae_mean double, tuned_cv_mae_std double, "
    "train_mae double, train_r2 double, test_mae double, test_rmse double, test_r2 double, "
    "features_used int, params map<string,string>, status string, error string"
)
_FIELDS = [part.strip().split(" ")[0] for part in RESULT_SCHEMA.split(", ")]


@dataclass
class TrainingData:
    """Imputed rows with split and fold, and the features each cohort uses."""

    rows: DataFrame
    target: str
    cohort: str
    chosen: dict[str, list[str]]
    fills: dict[str, dict[str, float]]
    failed: dict[str, str] = field(default_factory=dict)
    _vectors: dict = field(default_factory=dict)
    _lock: threading.Lock = field(default_factory=threading.Lock)
    _grower: growth.Grower | None = None
    _sums: dict | None = None

    @property
    def spark(self) -> SparkSession:
        return self.rows.sparkSession

    @property
    def features(self) -> list[str]:
        return sorted({f for names in self.chosen.values() for f in names})

    @property
    def train_rows(self) -> DataFrame:
        return self.rows.where(F.col("split") == "train")

    @property
    def sums(self) -> dict[str, linear.CohortSums]:
        """Sums of the training rows, shared by all linear models."""
        if self._sums is None:
            self._sums = linear.training_sums(self.train_rows, self.features, self.target, self.cohort)
        return self._sums

    def stages(self, cohort: str) -> list:
        """Impute and assemble: the leading stages of a saved tree model."""
        names = self.chosen[cohort]
        filled = ", ".join(f"coalesce(cast(`{f}` as double), {_sql(self.fills.get(cohort, {}).get(f))}) AS `__x_{f}`" for f in names)
        return [SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__"),
                VectorAssembler(inputCols=[f"__x_{f}" for f in names], outputCol="features", handleInvalid="error")]

    def vectors(self, cohort: str) -> DataFrame:
        """(label, split, fold, features) of one cohort, kept for the many passes of tree training."""
        with self._lock:
            if cohort not in self._vectors:
                rows = self.rows.where(F.col(self.cohort) == cohort).withColumn("label", F.col(self.target).cast("double"))
                assembled = PipelineModel(stages=self.stages(cohort)).transform(rows)
                self._vectors[cohort] = assembled.select("label", "split", "fold", "features").persist(StorageLevel.MEMORY_AND_DISK)
            return self._vectors[cohort]

    @property
    def grower(self) -> growth.Grower:
        """Binned blocks of all cohorts, shared by every tree that grows from histograms."""
        if self._grower is None:
            self._grower = growth.Grower(self.rows, self.target, self.cohort, self.chosen)
        return self._grower

    def release(self) -> None:
        if self._grower is not None:
            self._grower.release()
            self._grower = None
        for df in (self.rows, *self._vectors.values()):
            df.unpersist()


def _sql(value: float | None) -> str:
    return "cast(null as double)" if value is None else f"{float(value)!r}D"


@dataclass
class Training:
    results: DataFrame
    models: dict[tuple[str, str], PipelineModel]
    importances: DataFrame


def training_data(df: DataFrame, target: str, chosen: dict[str, list[str]], config: CohortConfig,
                  gaps: DataFrame | None = None) -> TrainingData:
    """Impute the chosen features by cohort medians and keep the narrow table for training; rows of a coded table, which lies in
    storage, are read again by each pass instead.

    ``gaps`` are medians a selection has already computed. Every chosen feature gets a median, also one without gaps in
    the rows it is fitted on: rows scored later may miss it. A cohort with a feature without any value is left out and named in
    ``failed``, so that the others train; if no cohort is left it is an error.
    """
    cohort = config.cohort
    features = sorted({f for names in chosen.values() for f in names})
    source = df.where(F.col(cohort).isin(sorted(chosen)))
    wanted = [(c, f) for c, names in chosen.items() for f in names]
    known = {} if gaps is None else {(r[cohort], r.feature): r.value for r in collect_bounded(gaps.where(F.col("value").isNotNull()))}
    lacking = sorted({f for c, f in wanted if (c, f) not in known})
    if lacking:
        fit = source.where(F.col("split") == "train") if config.fit_on == "train" else source
        for r in collect_bounded(medians(fit, lacking, [cohort])):
            known.setdefault((r[cohort], r.feature), r.value)
    void = [pair for pair in wanted if known.get(pair) is None]
    failed = {c: "features without any value: " + ", ".join(f for d, f in void if d == c) for c, _ in void}
    if void and len(failed) == len(chosen):
        raise ValueError(f"features without any value in their cohort: {void}")
    chosen = {c: names for c, names in chosen.items() if c not in failed}
    features = sorted({f for names in chosen.values() for f in names})
    source, wanted = source.where(F.col(cohort).isin(sorted(chosen))), [(c, f) for c, f in wanted if c in chosen]
    fills: dict[str, dict[str, float]] = {}
    for c, f in wanted:
        fills.setdefault(c, {})[f] = known[c, f]
    table = small_frame(df.sparkSession, [(c, f, known[c, f]) for c, f in wanted], f"{cohort} string, feature string, value double")
    key = CODE if CODE in df.columns else "row_key"
    rows = fill(source, table, features, cohort).where(F.col(target).isNotNull()).select(
        *dict.fromkeys([cohort, key, "split", "fold", target, *features]))
    return TrainingData(rows if key == CODE else rows.persist(StorageLevel.MEMORY_AND_DISK), target, cohort, chosen, fills, failed)


# --- linear models --------------------------------------------------------

def base_specs(scaler: str = "minmax") -> list[linear.LinearSpec]:
    return [linear.LinearSpec(name, kind, 0.0 if kind == "ols" else 1.0, scaler)
            for name, kind in registry.LINEAR_KINDS.items()]


def _linear_specs(name: str, points: Sequence[dict], scaler: str = "minmax") -> list[linear.LinearSpec]:
    return [linear.LinearSpec(f"{name}#{i}", registry.LINEAR_KINDS[name], scaler=scaler, **p) for i, p in enumerate(points)]


def linear_scores(data: TrainingData, specs, sums=None, folds: bool = True):
    """Fits of every candidate and their scores, as (fits, scores DataFrame)."""
    if sums is None:
        sums = data.sums
    fits = linear.fit_all(sums, data.chosen, data.target, specs, folds)
    return fits, linear.score(data.rows, data.target, fits, data.cohort), sums


def _by_model(scores: DataFrame, cohort: str) -> dict[tuple[str, str], dict]:
    """Collect scores as {(cohort, model): {cv: [...], train: row, test: row}}."""
    table: dict[tuple[str, str], dict] = {}
    for r in collect_bounded(scores):
        slot = table.setdefault((r[cohort], r.model), {"cv": []})
        if r.stage == "cv":
            slot["cv"].append(r)
        else:
            slot[r.split] = r
    return table


def _cv(rows, metric: str = "mae") -> tuple[float | None, float | None]:
    values = [getattr(r, metric) for r in rows if getattr(r, metric) is not None]
    return (statistics.fmean(values), statistics.pstdev(values)) if values else (None, None)


def _best(candidates: dict, metric: str):
    """Key of the best cross-validated candidate: lowest MAE or highest R2."""
    sign = -1.0 if metric == "r2" else 1.0
    scored = [(sign * score, key) for key, score in candidates.items() if score is not None]
    return min(scored)[1] if scored else None


def _record(data: TrainingData, cohort: str, model: str, variant: str = "base", **values) -> dict:
    return {"target": data.target, "cohort": cohort, "model": model, "variant": variant,
            "features_used": len(data.chosen[cohort]), "status": "ok", **values}


def _final(slot: dict) -> dict:
    train, test = slot.get("train"), slot.get("test")
    return {
        "train_mae": train and train.mae, "train_r2": train and train.r2,
        "test_mae": test and test.mae, "test_rmse": test and test.rmse, "test_r2": test and test.r2,
    }


def linear_pipeline(data: TrainingData, fit: linear.LinearFit) -> PipelineModel:
    """The fitted formula as a saveable pipeline of SQL stages."""
    fills = data.fills.get(fit.cohort, {})
    filled = ", ".join(f"coalesce(cast(`{f}` as double), {_sql(fills.get(f))}) AS `__x_{f}`" for f in fit.features)
    plain = linear.prediction_sql(fit, "__x_")
    return PipelineModel(stages=[SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__"),
                                 SQLTransformer(statement=f"SELECT *, {plain} AS prediction FROM __THIS__")])


def train_linear(data: TrainingData, names: Sequence[str], scaler: str = "minmax", search: "Search | None" = None,
                 cohorts: Sequence[str] | None = None):
    """Base candidates and, with a search, their penalty grids: one pass for sums, one for scores."""
    plan = [s for s in base_specs(scaler) if s.name in names]
    points: dict[str, list[dict]] = {}
    if search:
        for name in names:
            if name in search.spaces:
                points[name] = search.points(name)
                plan = plan + _linear_specs(name, points[name], scaler)
    return _linear_records(data, {c: plan for c in (cohorts or data.chosen)}, names, points, search.metric if search else "mae")


def tolerant_linear(data: TrainingData, names: Sequence[str], scaler: str, search: "Search | None", cohorts: Sequence[str] | None = None):
    """``train_linear`` in shared passes; if they fail, model by model, then cohort by cohort, so that only what fails is reported as failed."""
    cohorts = list(cohorts or data.chosen)
    try:
        return train_linear(data, names, scaler, search, cohorts)
    except Exception as error:
        if len(names) == len(cohorts) == 1:
            reason = str(error) or type(error).__name__
            return [_record(data, cohorts[0], names[0]) | {"status": "failed", "error": reason}], {}
        parts = [([n], cohorts) for n in names] if len(names) > 1 else [(names, [c]) for c in cohorts]
        done = [tolerant_linear(data, n, scaler, search, c) for n, c in parts]
        return sum((d[0] for d in done), []), {k: v for d in done for k, v in d[1].items()}


def _linear_records(data, plan, names, points, metric, label=lambda n: n, variant="base"):
    fits, scores, _ = linear_scores(data, plan)
    table = _by_model(scores, data.cohort)
    final = {(f.cohort, f.spec.name): f for f in fits if f.left_out == linear.FINAL}
    records, kept = [], {}
    for cohort in plan:
        for name in names:
            base = table.get((cohort, name))
            trials = {f"{name}#{i}": _cv(table[cohort, f"{name}#{i}"]["cv"], metric)[0]
                      for i in range(len(points.get(name, ()))) if (cohort, f"{name}#{i}") in table}
            winner = _best(trials, metric) or (name if base else None)
            if winner is None:
                records.append(_record(data, cohort, label(name), variant) | {"status": "failed", "error": "no training rows"})
                continue
            slot, fit = table[cohort, winner], final[cohort, winner]
            values = _final(slot)
            if base:
                values["base_cv_mae_mean"], values["base_cv_mae_std"] = _cv(base["cv"])
            if trials:
                values["tuned_cv_mae_mean"], values["tuned_cv_mae_std"] = _cv(slot["cv"])
            params = {"alpha": repr(fit.spec.alpha), "scaler": fit.spec.scaler, "kind": fit.spec.kind}
            records.append(_record(data, cohort, label(name), variant, params=params, **values) | {"features_used": len(fit.features)})
            kept[cohort, label(name)] = fit
    return records, kept


def train_single_features(data: TrainingData, kind: str = "ols", alpha: float = 0.0, scaler: str = "none",
                          label=lambda f: f, variant: str = "base") -> Training:
    """One model per feature and cohort, named after the feature: how far does each get alone?"""
    plan = {c: [linear.LinearSpec(f, kind, alpha, scaler, features=(f,)) for f in names] for c, names in data.chosen.items()}
    records, fits = _linear_records(data, plan, data.features, {}, "mae", label, variant)
    models = {key: linear_pipeline(data, fit) for key, fit in fits.items()}
    return Training(results_frame(data.spark, records), models, importance_frame(data, models, fits))


# --- tree models ----------------------------------------------------------

def _folds(data: TrainingData, cohort: str) -> list[int]:
    train = data.vectors(cohort).where(F.col("split") == "train")
    return sorted(r.fold for r in train.select("fold").distinct().collect())


def fold_scores(data: TrainingData, cohort: str, spec: registry.TreeSpec, candidates: Sequence[dict],
                parallelism: int = 4) -> list[tuple]:
    """(candidate, fold, mae, rmse, r2) of every candidate on every left-out fold."""
    train = data.vectors(cohort).where(F.col("split") == "train")

    def one(job):
        i, fold = job
        model = spec.build(**candidates[i]).fit(train.where(F.col("fold") != fold))
        m = model.transform(train.where(F.col("fold") == fold)).agg(*metric_columns()).first()
        return i, fold, m.mae, m.rmse, m.r2

    jobs = [(i, fold) for i in range(len(candidates)) for fold in _folds(data, cohort)]
    with ThreadPoolExecutor(parallelism) as pool:
        return list(pool.map(one, jobs))


def _mean_by_candidate(scores: list[tuple], metric: str) -> dict[int, float | None]:
    column = {"mae": 2, "rmse": 3, "r2": 4}[metric]
    grouped: dict[int, list[float]] = {}
    for row in scores:
        if row[column] is not None:
            grouped.setdefault(row[0], []).append(row[column])
    return {i: statistics.fmean(v) for i, v in grouped.items()}


def train_tree(data: TrainingData, cohort: str, spec: registry.TreeSpec, cv: bool = True, candidates: Sequence[dict] = (),
               metric: str = "mae", parallelism: int = 4, name: str | None = None, variant: str = "base"):
    """Cross-validate, search if candidates are given, fit on all training rows and score."""
    name = name or spec.name
    try:
        values: dict = {}
        changes: dict = {}
        if cv and variant == "base":
            maes = [s[2] for s in fold_scores(data, cohort, spec, [{}], parallelism)]
            values["base_cv_mae_mean"], values["base_cv_mae_std"] = statistics.fmean(maes), statistics.pstdev(maes)
        if candidates:
            scores = fold_scores(data, cohort, spec, candidates, parallelism)
            best = _best(_mean_by_candidate(scores, metric), metric)
            changes = candidates[best]
            maes = [s[2] for s in scores if s[0] == best]
            values["tuned_cv_mae_mean"], values["tuned_cv_mae_std"] = statistics.fmean(maes), statistics.pstdev(maes)
        vectors = data.vectors(cohort)
        model = spec.build(**changes).fit(vectors.where(F.col("split") == "train"))
        rows = model.transform(vectors).groupBy("split").agg(*metric_columns()).collect()
        values |= _final({r.split: r for r in rows})
        params = {p.name: str(v) for p, v in model.extractParamMap().items()}
        return _record(data, cohort, name, variant, params=params, **values), PipelineModel(stages=[*data.stages(cohort), model])
    except Exception as error:  # one failing model must not stop the others
        reason = str(error) or type(error).__name__
        return _record(data, cohort, name, variant) | {"status": "failed", "error": reason}, None


# --- trees from shared histograms -------------------------------------------

def _fold_metrics(grown: growth.Grown, cohort: str, index: int) -> list[tuple]:
    """(fold, mae, rmse, r2) of the left-out folds."""
    return [(fold, *values[1:]) for (c, i, fold, split), values in sorted(grown.scores.items(), key=lambda kv: kv[0][2])
            if c == cohort and i == index and split == "cv"]


def _grown_values(grown: growth.Grown, cohort: str, index: int) -> dict:
    part = {s: grown.scores.get((cohort, index, growth.FINAL, s)) for s in ("train", "test")}
    train, test = part["train"], part["test"]
    return {"train_mae": train and train[1], "train_r2": train and train[3],
            "test_mae": test and test[1], "test_rmse": test and test[2], "test_r2": test and test[3]}


def grown_pipeline(data: TrainingData, cohort: str, grown: growth.Grown, index: int, growth_: growth.Growth) -> PipelineModel:
    """The trees as a saveable pipeline: fill gaps, then one SQL expression over flat node arrays."""
    names, fit = data.chosen[cohort], grown.fits[cohort, index]
    formula = growth.prediction_sql(fit.base, grown.trees(cohort, index, growth_), [f"__x_{f}" for f in names], growth_.depth)
    return PipelineModel(stages=[data.stages(cohort)[0], SQLTransformer(statement=f"SELECT *, {formula} AS prediction FROM __THIS__")])


def train_grown(data: TrainingData, wanted: dict[str, list[registry.GrownSpec]], cv: bool = True, candidates=None, metric: str = "mae",
                label=lambda n: n, variant: str = "base", keep: bool = True):
    """Cross-validate, search and fit the models ``wanted`` by cohort: (records, models, importances).

    All of them grow in the same passes; final trees grow for the winners only. ``candidates`` gives the parameter sets of
    a model; without ``keep`` there are records only. If a pass fails, the models are tried one by one, so that only the failing ones are reported as failed.
    """
    specs = list({s.name: s for each in wanted.values() for s in each}.values())
    try:
        return _train_grown(data, wanted, specs, cv, candidates or (lambda name: ()), metric, label, variant, keep)
    except Exception as error:
        if len(specs) > 1:
            parts = [train_grown(data, {c: [s for s in each if s.name == spec.name] for c, each in wanted.items()}, cv, candidates, metric, label, variant, keep) for spec in specs]
            return sum((p[0] for p in parts), []), {k: v for p in parts for k, v in p[1].items()}, {k: v for p in parts for k, v in p[2].items()}
        reason = str(error) or type(error).__name__
        return [_record(data, c, label(s.name), variant) | {"status": "failed", "error": reason} for c, each in wanted.items() for s in each], {}, {}


def _train_grown(data, wanted, specs, cv, candidates, metric, label, variant, keep):
    changes = {s.name: [dict(c) for c in candidates(s.name)] for s in specs}
    growths, at = [], {}
    for s in specs:
        for k, change in enumerate([{}, *changes[s.name]]):
            at[s.name, k] = len(growths)
            growths.append(s.grown(**change))
    base_cv = cv and variant == "base"
    scored = None
    if any(changes.values()):
        scored = data.grower.grow(growths, folds=True, final=False)
    winner: dict[tuple[str, str], int] = {}
    column = {"mae": 0, "rmse": 1, "r2": 2}[metric]
    for c, each in wanted.items():
        for s in each:
            means = {k: statistics.fmean(v) for k in range(1, len(changes[s.name]) + 1)
                     if (v := [m[1 + column] for m in _fold_metrics(scored, c, at[s.name, k]) if m[1 + column] is not None])} if scored else {}
            winner[c, s.name] = _best(means, metric) or 0
    finals = sorted({at[n, k] for (_, n), k in winner.items()})
    grown = data.grower.grow([growths[i] for i in finals], folds=base_cv and scored is None, final=True, keep=keep)
    records, models, importances = [], {}, {}
    for c, each in wanted.items():
        for s in each:
            k = winner[c, s.name]
            chosen, index = growths[at[s.name, k]], finals.index(at[s.name, k])
            if (c, index) not in grown.fits:
                records.append(_record(data, c, label(s.name), variant) | {"status": "failed", "error": "no training rows or features"})
                continue
            values = _grown_values(grown, c, index)
            folds = lambda source, i: [m[1] for m in _fold_metrics(source, c, i)]
            if base_cv and (maes := folds(*((scored, at[s.name, 0]) if scored else (grown, index)))):
                values["base_cv_mae_mean"], values["base_cv_mae_std"] = statistics.fmean(maes), statistics.pstdev(maes)
            if k and (maes := folds(scored, at[s.name, k])):
                values["tuned_cv_mae_mean"], values["tuned_cv_mae_std"] = statistics.fmean(maes), statistics.pstdev(maes)
            records.append(_record(data, c, label(s.name), variant, params=s.parameters(chosen), **values))
            if not keep:
                continue
            models[c, label(s.name)] = grown_pipeline(data, c, grown, index, chosen)
            importances[c, label(s.name)] = grown.importances(c, index, chosen)
    return records, models, importances


def sequential_trials(data: TrainingData, spec: registry.GrownSpec, ranges: dict[str, tuple], iterations: int = 30, batch: int = 10,
                      metric: str = "mae", seed: int = registry.SEED) -> DataFrame:
    """Trials of a sequential search, cross-validated; a batch grows in shared passes for all cohorts. ``chosen`` marks the best."""
    column, sign = {"mae": (1, 1.0), "rmse": (2, 1.0), "r2": (3, -1.0)}[metric]

    def losses(points: list[dict]) -> dict[str, list[float | None]]:
        grown = data.grower.grow([spec.grown(**registry.spark_params(p, spec.name in registry.BOOSTED)) for p in points], final=False)
        mean = lambda values: sign * statistics.fmean(values) if values else None
        return {c: [mean([m[column] for m in _fold_metrics(grown, c, i) if m[column] is not None]) for i in range(len(points))] for c in data.chosen}

    trials = sampler.sequential_search(data.spark, sorted(data.chosen), spec.name, ranges, losses, iterations, batch, seed)
    best = trials.groupBy("cohort").agg(F.min(F.struct("loss", "trial")).alias("b")).select("cohort", F.col("b.trial").alias("best"))
    return trials.join(F.broadcast(best), "cohort").withColumn("chosen", F.col("trial") == F.col("best")).drop("best")


# --- orchestration --------------------------------------------------------

@dataclass(frozen=True)
class Search:
    """How hyper-parameters are searched: ``random``, ``grid`` or ``ranges``."""

    method: str = "random"
    iterations: int = 30
    metric: str = "mae"
    spaces: dict = field(default_factory=lambda: registry.SEARCH_SPACES)
    ranges: dict = field(default_factory=lambda: registry.RANGES)
    seed: int = registry.SEED

    def points(self, name: str) -> list[dict]:
        if self.method == "ranges" and name in self.ranges:
            return registry.range_points(self.ranges[name], self.iterations, self.seed)
        if self.method == "grid":
            return registry.grid(self.spaces.get(name, {}))
        return registry.random_points(self.spaces.get(name, {}), self.iterations, self.seed) if name in self.spaces else []

    def spark_candidates(self, name: str) -> list[dict]:
        return [registry.spark_params(p, name in registry.BOOSTED) for p in self.points(name)]


def train_models(data: TrainingData, names: Sequence[str] | None = None, profile_name: str = "full",
                 cv: bool = True, search: Search | None = None, scaler: str = "minmax", parallelism: int = 4,
                 trees: dict[str, registry.TreeSpec] | None = None, keep: bool = True) -> Training:
    """All models for all cohorts. Linear models share two passes; tree fits run as concurrent jobs. Without ``keep`` trees have results only."""
    trees = trees or registry.tree_models(profile_name)
    names = list(names or [*registry.LINEAR_KINDS, *trees])
    records, models, fits = [], {}, {}
    wanted = [n for n in names if n in registry.LINEAR_KINDS]
    if wanted:
        records, fits = tolerant_linear(data, wanted, scaler, search)
        models = {key: linear_pipeline(data, fit) for key, fit in fits.items()}
    grown = [trees[n] for n in names if isinstance(trees.get(n), registry.GrownSpec)]
    gains: dict = {}
    if grown:
        found, formulas, gains = train_grown(data, {c: grown for c in data.chosen}, cv, search.spark_candidates if search else None, search.metric if search else "mae", keep=keep)
        records = records + found
        models |= formulas
    jobs = [(c, trees[n]) for c in data.chosen for n in names if isinstance(trees.get(n), registry.TreeSpec)]

    def run(job):
        cohort, spec = job
        return train_tree(data, cohort, spec, cv, search.spark_candidates(spec.name) if search else (),
                          search.metric if search else "mae", parallelism)

    with ThreadPoolExecutor(max(1, min(parallelism, len(jobs) or 1))) as pool:
        for record, model in pool.map(run, jobs):
            records.append(record)
            if model is not None:
                models[record["cohort"], record["model"]] = model
    records = records + [{"target": data.target, "cohort": c, "model": n, "variant": "base", "features_used": 0, "status": "failed", "error": reason}
                         for c, reason in data.failed.items() for n in names]
    return Training(results_frame(data.spark, records), models, importance_frame(data, models, fits, gains))


def results_frame(spark: SparkSession, records: Sequence[dict]) -> DataFrame:
    return small_frame(spark, [tuple(r.get(f) for f in _FIELDS) for r in records], RESULT_SCHEMA)


def importance_frame(data: TrainingData, models: dict, fits: dict, gains: dict | None = None) -> DataFrame:
    """(target, cohort, model, feature, importance, sign): tree importances or absolute coefficients."""
    rows = []
    for (cohort, name), model in models.items():
        fit = fits.get((cohort, name))
        if fit is not None:
            pairs = zip(fit.features, fit.coefficients)
        elif gains and (cohort, name) in gains:
            pairs = zip(data.chosen[cohort], gains[cohort, name])
        else:
            pairs = zip(data.chosen[cohort], model.stages[-1].featureImportances.toArray())
        for feature, value in pairs:
            value = float(value)
            rows.append((data.target, cohort, name, feature, abs(value), (value > 0) - (value < 0)))
    return small_frame(data.spark, rows, "target string, cohort string, model string, feature string, importance double, sign int")


def finetune_top(data: TrainingData, base: DataFrame, k: int = 2, rank_by: str = "r2", search: Search | None = None,
                 profile_name: str = "full", parallelism: int = 4,
                 trees: dict[str, registry.TreeSpec] | None = None) -> Training:
    """Tune the ``k`` best base models of every cohort again over finer spaces."""
    from cohortwise.operators.compare import rank_models

    search = search or Search(spaces=registry.FINE_SPACES)
    trees = trees or registry.tree_models(profile_name)
    top = [(r.cohort, r.model) for r in collect_bounded(
        rank_models(base.where("status = 'ok'"), rank_by).where(F.col("rank") <= k).orderBy("cohort", "rank"))]
    records, models, fits = [], {}, {}
    label = lambda name: f"Tuned {name}"
    plan: dict[str, list] = {}
    points = {n: search.points(n) or [{}] for n in registry.LINEAR_KINDS}
    for cohort, name in top:
        if name in registry.LINEAR_KINDS:
            plan.setdefault(cohort, []).extend(_linear_specs(name, points[name]))
    if plan:
        linear_names = [n for n in registry.LINEAR_KINDS if any((c, n) in top for c in plan)]
        records, fits = _linear_records(data, plan, linear_names, points, search.metric, label, "tuned")
        models = {key: linear_pipeline(data, fit) for key, fit in fits.items()}
    grown: dict[str, list] = {}
    for c, n in top:
        if isinstance(trees.get(n), registry.GrownSpec):
            grown.setdefault(c, []).append(trees[n])
    gains: dict = {}
    if grown:
        found, formulas, gains = train_grown(data, grown, False, lambda n: _tuning_candidates(search, n) or [{}], search.metric, label, "tuned")
        records = records + found
        models |= formulas
    jobs = [(c, n) for c, n in top if isinstance(trees.get(n), registry.TreeSpec)]
    run = lambda job: train_tree(data, job[0], trees[job[1]], False, _tuning_candidates(search, job[1]) or [{}],
                                 search.metric, parallelism, label(job[1]), "tuned")
    with ThreadPoolExecutor(max(1, min(parallelism, len(jobs) or 1))) as pool:
        for record, model in pool.map(run, jobs):
            records.append(record)
            if model is not None:
                models[record["cohort"], record["model"]] = model
    return Training(results_frame(data.spark, records), models, importance_frame(data, models, fits, gains))


def _tuning_candidates(search: Search, name: str) -> list[dict]:
    """Boosted models draw from ranges, the others from their grid."""
    if name in registry.BOOSTED and name in search.ranges and search.method != "grid":
        points = registry.range_points(search.ranges[name], search.iterations, search.seed)
        return [registry.spark_params(p, True) for p in points]
    return search.spark_candidates(name)


def multi_metric_search(data: TrainingData, cohort: str, spec: registry.TreeSpec | registry.GrownSpec, candidates: Sequence[dict],
                        parallelism: int = 4) -> DataFrame:
    """Mean MAE, RMSE and R2 of every candidate; ``chosen`` marks the lowest MAE."""
    if isinstance(spec, registry.GrownSpec):
        grown = data.grower.grow([spec.grown(**c) for c in candidates], final=False, cohorts=[cohort])
        scores = [(i, *m) for i in range(len(candidates)) for m in _fold_metrics(grown, cohort, i)]
    else:
        scores = fold_scores(data, cohort, spec, candidates, parallelism)
    means = {m: _mean_by_candidate(scores, m) for m in ("mae", "rmse", "r2")}
    best = _best(means["mae"], "mae")
    rows = [(cohort, spec.name, i, {k: str(v) for k, v in p.items()}, *(means[m].get(i) for m in ("mae", "rmse", "r2")), i == best)
            for i, p in enumerate(candidates)]
    return small_frame(data.spark, rows, "cohort string, model string, candidate int, params map<string,string>, "
                       "cv_mae double, cv_rmse double, cv_r2 double, chosen boolean")


# --- scaler comparison ----------------------------------------------------

# Scaler names of the comparison table.
SCALER_NAMES = {"power": "PowerTransformer", "minmax": "MinMaxScaler", "standard": "StandardScaler", "none": "NoScaling"}
SCALER_SCHEMA = ("target string, cohort string, scaler string, model string, test_mae double, test_rmse double, test_r2 double, "
                 "cv_mae_mean double, cv_mae_std double, n_features int, n_samples bigint")


def compare_scalers(data: TrainingData, tree_names: Sequence[str] = (registry.FOREST, registry.BOOSTING, registry.TREE),
                    profile_name: str = "full", parallelism: int = 4, scalers: Sequence[str] = tuple(SCALER_NAMES)) -> DataFrame:
    """Every scaler with every model. Affine scalers share one set of sums; tree
    models ignore scaling, so they are fitted once and their rows repeated. Only the ``scalers`` asked for are fitted."""
    if "power" in scalers:  # its fit passes over the rows many times
        data.rows.persist(StorageLevel.MEMORY_AND_DISK)
    counts = {r[data.cohort]: r["count"] for r in collect_bounded(data.rows.groupBy(data.cohort).count())}
    rows = []

    def add(cohort, scaler, model, values):
        rows.append((data.target, cohort, SCALER_NAMES[scaler], model, *values, len(data.chosen[cohort]), counts[cohort]))

    def linear_rows(source: TrainingData, scalers):
        specs = [linear.LinearSpec(f"{s}|{b.name}", b.kind, b.alpha, s) for s in scalers for b in base_specs()]
        _, scores, _ = linear_scores(source, specs)
        for (cohort, label), slot in sorted(_by_model(scores, data.cohort).items()):
            scaler, model = label.split("|")
            test = slot.get("test")  # a cohort may have no test rows
            add(cohort, scaler, model, (test and test.mae, test and test.rmse, test and test.r2, *_cv(slot["cv"])))

    affine = [s for s in linear.SCALERS if s in scalers]
    if affine:
        linear_rows(data, affine)
    if "power" in scalers:
        bent = power_transform(data.rows, data.features, data.cohort, data.train_rows).persist(StorageLevel.MEMORY_AND_DISK)
        linear_rows(TrainingData(bent, data.target, data.cohort, data.chosen, {}), ["power"])
        bent.unpersist()
    if tree_names:
        trained = train_models(data, tree_names, profile_name, parallelism=parallelism, trees=registry.compared_models(profile_name), keep=False)
        for r in collect_bounded(trained.results.where("status = 'ok'")):
            for scaler in scalers:
                add(r.cohort, scaler, r.model, (r.test_mae, r.test_rmse, r.test_r2, r.base_cv_mae_mean, r.base_cv_mae_std))
    return small_frame(data.spark, rows, SCALER_SCHEMA)
