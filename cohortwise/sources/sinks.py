"""Writing and re-reading datasets, rankings, summaries, parameters and models."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_cohorts(df: DataFrame, path: str, cohort: str, fmt: str = "parquet") -> None:
    """One folder per cohort, so a reader of one cohort prunes the others."""
    writer = df.write.mode("overwrite").partitionBy(cohort)
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)


def read_cohorts(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.parquet(path)


def write_results(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A results table (one row per target, cohort and model) as a single file."""
    flat = df
    if fmt == "csv":  # CSV has no maps
        flat = df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, T.MapType) else F.col(f.name) for f in df.schema])
        flat.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    elif fmt == "json":
        flat.coalesce(1).write.mode("overwrite").json(path)
    else:
        flat.coalesce(1).write.mode("overwrite").parquet(path)


def read_results(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else getattr(reader, fmt)(path)


def best_of(rankings: DataFrame) -> DataFrame:
    """Best row of every target and cohort of a stored rankings table."""
    return rankings.where(F.col("rank") == 1)


def selected_features_table(selection: DataFrame) -> DataFrame:
    return selection.where("selected").select("cohort", "feature", "position").orderBy("cohort", "position")


def run_summary(results: DataFrame, selection: DataFrame, originals: Sequence[str], engineered: Sequence[str]) -> DataFrame:
    """One nested row per target and cohort: features, metrics by model and the best model."""
    chosen = selection.where("selected").groupBy("cohort").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("position", "feature"))), lambda s: s["feature"]).alias("selected_features"))
    metrics = F.struct("test_mae", "test_rmse", "test_r2", "train_mae", "train_r2", "base_cv_mae_mean", "base_cv_mae_std")
    per_cohort = results.where("status = 'ok'").groupBy("target", "cohort").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("model"), metrics.alias("metrics")))).alias("results"),
        F.max_by("model", "test_r2").alias("best_model"), F.max("test_r2").alias("best_r2"))
    return per_cohort.join(chosen, "cohort").select(
        "target", "cohort",
        F.array(*[F.lit(c) for c in originals]).alias("original_features"),
        F.array(*[F.lit(c) for c in engineered]).alias("engineered_features"),
        "selected_features", "results", "best_model", "best_r2", F.size("selected_features").alias("n_features"))


def write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def parameters(results: DataFrame) -> DataFrame:
    """(target, cohort, model, parameter, value) of every fitted model."""
    return results.select("target", "cohort", "model", F.explode("params").alias("parameter", "value"))


def model_path(base: str, target: str, cohort: str) -> str:
    return f"{base}/target={target}/cohort={cohort}"


def save_model(model: PipelineModel, base: str, target: str, cohort: str) -> str:
    path = model_path(base, target, cohort)
    model.write().overwrite().save(path)
    return path


def load_model(base: str, target: str, cohort: str) -> PipelineModel:
    return PipelineModel.load(model_path(base, target, cohort))


# --- run store ---------------------------------------------------------------

class RunStore:
    """Stored runs that readers see as a whole or not at all.

    A run is written into a folder of its own below ``runs``; its manifest, one small file that names the tables and their
    schemas, is created last. Readers list manifests only, so a run that failed between two tables is never read, and an earlier
    run is never touched. A manifest is created under another name and renamed, which the file systems Spark writes to do
    in one step or, in object stores, as one put.
    """

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._files = self._path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def save(self, tables: dict[str, DataFrame], models: Callable[[str], None] | None = None, run: str | None = None) -> str:
        """Write all ``tables``, let ``models`` write below the run's folder, then publish the run under its name."""
        run = run or uuid.uuid4().hex
        if self._files.exists(self._path(self._manifest(run))):
            raise ValueError(f"run {run} exists")
        folder = f"{self.base}/runs/{run}-{uuid.uuid4().hex[:8]}"
        for name, df in tables.items():
            df.write.parquet(f"{folder}/{name}")
        if models:
            models(f"{folder}/models")
        manifest = {"run": run, "folder": folder, "tables": {name: df.schema.jsonValue() for name, df in tables.items()}}
        staged = self._path(f"{self.base}/manifests/.{uuid.uuid4().hex}")
        out = self._files.create(staged)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self._files.rename(staged, self._path(self._manifest(run))):
            self._files.delete(staged, False)
            raise ValueError(f"run {run} exists")
        return run

    def _manifest(self, run: str) -> str:
        return f"{self.base}/manifests/{run}.json"

    def manifests(self) -> dict[str, dict]:
        """Published runs by name."""
        where = self._path(f"{self.base}/manifests")
        names = [s.getPath().getName() for s in self._files.listStatus(where)] if self._files.exists(where) else []
        paths = [f"{self.base}/manifests/{n}" for n in sorted(names) if n.endswith(".json") and not n.startswith(".")]
        if not paths:
            return {}
        found = [json.loads(r.value) for r in self.spark.read.text(paths, wholetext=True).collect()]  # one small file a run
        return {m["run"]: m for m in found}

    def read(self, table: str) -> DataFrame | None:
        """The table of all published runs, with their names in ``run``."""
        parts = [self.spark.read.schema(T.StructType.fromJson(m["tables"][table])).parquet(f"{m['folder']}/{table}").withColumn("run", F.lit(run))
                 for run, m in self.manifests().items() if table in m["tables"]]
        out = None
        for part in parts:
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def best(self, rank_by: str = "test_r2") -> DataFrame | None:
        """Best model of every target and cohort over all published runs; ties go to the first run and model by name."""
        rankings = self.read("rankings")
        if rankings is None:
            return None
        value = F.col(rank_by) if rank_by.endswith("r2") else -F.col(rank_by)
        key = F.struct(F.isnull(value).alias("none"), (-value).alias("back"), "run", "model")
        rows = rankings.groupBy("target", "cohort").agg(F.min_by(F.struct(*[c for c in rankings.columns if c not in ("target", "cohort")]), key).alias("r"))
        return rows.select("target", "cohort", "r.*")

    def folder(self, run: str) -> str:
        return self.manifests()[run]["folder"]
