"""Model registry, search spaces and their translation to Spark parameters."""

from __future__ import annotations

import math
import random
from dataclasses import dataclass, field, replace

from pyspark.ml.regression import RandomForestRegressor

from cohortwise.models.growth import Growth

SEED = 42

# Model names of the results tables.
OLS, RIDGE, LASSO = "Linear Regression", "Ridge Regression", "Lasso Regression"
FOREST, BOOSTING, TREE = "Random Forest", "Gradient Boosting", "Decision Tree"
SUBSAMPLED, SLOW, HISTOGRAM = "Boosting (subsampled)", "Boosting (slow)", "Boosting (histogram)"
LINEAR_KINDS = {OLS: "ols", RIDGE: "ridge", LASSO: "lasso"}
BOOSTED = (BOOSTING, SUBSAMPLED, SLOW, HISTOGRAM)


@dataclass(frozen=True)
class TreeSpec:
    """A tree-based model of Spark's own, by its parameters."""

    name: str
    estimator: type
    params: dict = field(default_factory=dict, hash=False)

    def build(self, **changes):
        known = {**self.params, **changes}
        accepted = {k: v for k, v in known.items() if self.estimator().hasParam(k)}
        return self.estimator(featuresCol="features", labelCol="label", predictionCol="prediction", **accepted)


@dataclass(frozen=True)
class GrownSpec:
    """A tree or boosted model that grows from shared histograms; candidates come in the vocabulary of Spark parameters."""

    name: str
    growth: Growth

    def grown(self, **changes) -> Growth:
        names = {"maxIter": "rounds", "numTrees": "rounds", "maxDepth": "depth", "minInstancesPerNode": "least", "stepSize": "step", "subsamplingRate": "rows", "maxBins": "bins", "seed": "seed"}
        known = {names[k]: v for k, v in changes.items() if k in names}
        share = changes.get("featureSubsetStrategy")
        if share is not None:
            known["columns"] = 1.0 if share == "all" else float(share)
        if "depth" in known and self.growth.shape != "level":
            known["depth"] = min(known["depth"], MAX_SHAPED_DEPTH)
        return replace(self.growth, **known)

    def parameters(self, growth: Growth) -> dict[str, str]:
        return {k: str(v) for k, v in vars(growth).items() if k != "bagged" or v}


#: Depth of symmetric and leaf-wise trees: a level of 2**12 nodes is the most they look at.
MAX_SHAPED_DEPTH = 12


def tree_models(profile: str = "full") -> dict[str, TreeSpec | GrownSpec]:
    """``full`` mirrors the usual settings; ``small`` keeps forests and boosting short.

    The three boosting profiles differ in algorithm: rows and columns sampled for each tree with penalised leaves,
    symmetric trees in small steps, and best-first trees over fine histograms.
    """
    full = profile == "full"
    trees, rounds = (200, 100) if full else (10, 5)
    specs = [
        TreeSpec(FOREST, RandomForestRegressor, dict(numTrees=trees, maxDepth=30 if full else 8,
                                                     featureSubsetStrategy="all", seed=SEED)),
        GrownSpec(BOOSTING, Growth(rounds=rounds, depth=3, step=0.1)),
        GrownSpec(TREE, Growth(depth=10)),
        GrownSpec(SUBSAMPLED, Growth(rounds=rounds, depth=6 if full else 4, step=0.3, l2=1.0, rows=0.8, columns=0.6)),
        GrownSpec(SLOW, Growth(rounds=rounds, depth=6 if full else 4, step=0.05, l2=3.0, shape="symmetric")),
        GrownSpec(HISTOGRAM, Growth(rounds=rounds, depth=6 if full else 4, step=0.1, least=20, shape="leaves", bins=255)),
    ]
    return {s.name: s for s in specs}


def compared_models(profile: str = "full") -> dict[str, TreeSpec | GrownSpec]:
    """``tree_models`` where only scores are wanted: the forest grows from the shared histograms too, with the same trees, depth and sampling."""
    models = tree_models(profile)
    forest = models[FOREST].params
    return models | {FOREST: GrownSpec(FOREST, Growth(rounds=forest["numTrees"], depth=forest["maxDepth"], seed=forest["seed"], bagged=True))}


def model_names() -> list[str]:
    return [*LINEAR_KINDS, *tree_models("small")]


def log_space(first: float, last: float, count: int) -> list[float]:
    return [10.0 ** (first + (last - first) * i / (count - 1)) for i in range(count)]


# Search spaces, in the vocabulary of the tabular-learning libraries.
SEARCH_SPACES = {
    FOREST: {"n_estimators": [50, 100, 200, 400, 800, 1200], "max_depth": [None, 4, 6, 8, 12, 16, 24, 32],
             "min_samples_split": [2, 5, 10, 20, 50], "min_samples_leaf": [1, 2, 4, 8, 16]},
    BOOSTING: {"n_estimators": [100, 300, 600, 1000, 1500], "learning_rate": [0.3, 0.1, 0.05, 0.01, 0.005, 0.001],
               "max_depth": [2, 3, 4, 5, 6], "subsample": [0.6, 0.8, 1.0]},
    TREE: {"max_depth": [2, 3, 4, 6, 8, 12, 20, None], "min_samples_split": [2, 5, 10, 20, 50],
           "min_samples_leaf": [1, 2, 4, 8, 16]},
    RIDGE: {"alpha": log_space(-4, 3, 20)},
    LASSO: {"alpha": log_space(-4, 3, 20)},
    SUBSAMPLED: {"n_estimators": [200, 500, 800, 1200, 1600],
                 "learning_rate": [0.3, 0.1, 0.05, 0.01, 0.005, 0.001, 0.0005],
                 "max_depth": [3, 4, 5, 6, 8, 10, 12], "subsample": [0.6, 0.8, 1.0], "colsample": [0.6, 0.8, 1.0]},
    HISTOGRAM: {"n_estimators": [200, 500, 800, 1200, 1600],
                "learning_rate": [0.3, 0.1, 0.05, 0.01, 0.005, 0.001, 0.0005],
                "max_depth": [-1, 3, 5, 7, 10, 12], "subsample": [0.6, 0.8, 1.0], "colsample": [0.6, 0.8, 1.0]},
    SLOW: {"n_estimators": [200, 500, 800, 1200, 1600], "learning_rate": [0.3, 0.1, 0.05, 0.01, 0.005, 0.001],
           "max_depth": [3, 4, 5, 6, 8]},
}
# Finer spaces of the second search.
FINE_SPACES = {
    RIDGE: {"alpha": log_space(-4, 3, 40)},
    LASSO: {"alpha": log_space(-4, 3, 40), "max_iter": [2000, 5000, 10000], "tol": [1e-3, 1e-4]},
    FOREST: {"n_estimators": [100, 200, 400, 800, 1200], "max_depth": [None, 4, 6, 8, 12, 16, 24, 32],
             "min_samples_split": [2, 5, 10, 20, 50], "min_samples_leaf": [1, 2, 4, 8, 16]},
    TREE: SEARCH_SPACES[TREE],
    BOOSTING: SEARCH_SPACES[BOOSTING],
}
# Fixed values. (kind, low, high): int steps of 100 or 1, log-uniform and uniform ranges.
RANGES = {
    SUBSAMPLED: {"n_estimators": ("hundreds", 200, 1600), "max_depth": ("int", 3, 12),
                 "learning_rate": ("log", 1e-4, 0.3), "subsample": ("uniform", 0.6, 1.0), "colsample": ("uniform", 0.6, 1.0)},
    HISTOGRAM: {"n_estimators": ("hundreds", 200, 1600), "max_depth": ("int", 3, 12),
                "learning_rate": ("log", 1e-4, 0.3), "subsample": ("uniform", 0.6, 1.0), "colsample": ("uniform", 0.6, 1.0)},
    SLOW: {"n_estimators": ("hundreds", 200, 1600), "max_depth": ("int", 3, 8), "learning_rate": ("log", 1e-4, 0.3)},
    BOOSTING: {"n_estimators": ("hundreds", 100, 1500), "max_depth": ("int", 2, 6),
               "learning_rate": ("log", 1e-4, 0.3), "subsample": ("uniform", 0.6, 1.0)},
}


def grid(space: dict[str, list]) -> list[dict]:
    """Every combination of a search space."""
    points = [{}]
    for name, values in space.items():
        points = [{**p, name: v} for p in points for v in values]
    return points


def random_points(space: dict[str, list], count: int, seed: int = SEED) -> list[dict]:
    """A seeded sample without replacement; the whole grid where it is smaller."""
    points = grid(space)
    return points if len(points) <= count else random.Random(seed).sample(points, count)


def range_points(ranges: dict[str, tuple], count: int, seed: int = SEED) -> list[dict]:
    """Seeded draws from continuous, logarithmic and stepped ranges."""
    rng = random.Random(seed)
    draw = {
        "int": lambda low, high: rng.randint(low, high),
        "hundreds": lambda low, high: 100 * rng.randint(low // 100, high // 100),
        "uniform": rng.uniform,
        "log": lambda low, high: math.exp(rng.uniform(math.log(low), math.log(high))),
    }
    return [{name: draw[kind](low, high) for name, (kind, low, high) in ranges.items()} for _ in range(count)]


def spark_params(point: dict, boosted: bool) -> dict:
    """Translate a point of a search space. Depth ends at Spark's limit of 30, and
    a minimum split size becomes half of it as minimum leaf size."""
    params = {}
    if "n_estimators" in point:
        params["maxIter" if boosted else "numTrees"] = int(point["n_estimators"])
    if "max_depth" in point:
        depth = point["max_depth"]
        params["maxDepth"] = 30 if depth is None or depth < 0 else min(30, int(depth))
    if "min_samples_leaf" in point or "min_samples_split" in point:
        params["minInstancesPerNode"] = max(point.get("min_samples_leaf", 1), math.ceil(point.get("min_samples_split", 2) / 2))
    if "learning_rate" in point:
        params["stepSize"] = float(point["learning_rate"])
    if "subsample" in point:
        params["subsamplingRate"] = float(point["subsample"])
    if "colsample" in point:
        share = float(point["colsample"])
        params["featureSubsetStrategy"] = "all" if share >= 1.0 else str(share)
    return params
