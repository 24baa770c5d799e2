"""Sequential search: Parzen densities of the good and the bad trials propose the next batch.

Trials so far are split by their loss. In every dimension both parts give a mixture of normal kernels, cut to the range, with
a broad kernel for the range itself; the width of a kernel is the distance to its farther neighbour. Draws from the good
part's mixture are ranked by the ratio of the two densities. A batch is proposed one point at a time, and proposed points
count as bad ones until their losses are known, so that a batch spreads.

Trials are few rows (one per candidate) and live in a DataFrame; their losses come from one shared growth per batch.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from cohortwise.bounded import small_frame

#: Random trials before the first proposal, share of trials that count as good, draws that compete for a place.
STARTUP, GOOD, DRAWS = 10, 0.25, 24

TRIAL_SCHEMA = "cohort string, model string, batch int, trial int, params map<string,string>, loss double"


class ParzenSampler:
    """Proposals over ``ranges``: name to (kind, low, high); kinds are int, hundreds, uniform and log."""

    def __init__(self, ranges: dict[str, tuple], seed: int = 42):
        self.ranges, self.rng = ranges, np.random.default_rng(seed)

    def _inner(self, name: str) -> tuple[float, float]:
        kind, low, high = self.ranges[name]
        if kind == "log":
            return math.log(low), math.log(high)
        half = {"int": 0.5, "hundreds": 50.0}.get(kind, 0.0)
        return low - half, high + half

    def _coordinate(self, name: str, value: float) -> float:
        return math.log(value) if self.ranges[name][0] == "log" else float(value)

    def _value(self, name: str, x: float):
        kind, low, high = self.ranges[name]
        if kind == "log":
            return min(high, max(low, math.exp(x)))
        if kind == "int":
            return int(min(high, max(low, math.floor(x + 0.5))))
        if kind == "hundreds":
            return int(min(high, max(low, 100 * math.floor(x / 100 + 0.5))))
        return min(high, max(low, x))

    def random(self, count: int) -> list[dict]:
        return [{name: self._value(name, self.rng.uniform(*self._inner(name))) for name in self.ranges} for _ in range(count)]

    def propose(self, trials: list[tuple[dict, float]], count: int) -> list[dict]:
        """The next ``count`` points after ``trials`` of (point, loss); random ones as long as there are few trials."""
        known = sorted(((loss, k) for k, (_, loss) in enumerate(trials) if loss is not None and math.isfinite(loss)))
        start = max(0, min(count, STARTUP - len(known)))
        out = self.random(start)
        good = [trials[k][0] for _, k in known[:max(1, math.ceil(GOOD * len(known)))]]
        bad = [trials[k][0] for _, k in known[len(good):]]
        while len(out) < count:
            point = {}
            for name in self.ranges:
                low, high = self._inner(name)
                near = _Mixture([self._coordinate(name, p[name]) for p in good], low, high)
                far = _Mixture([self._coordinate(name, p[name]) for p in [*bad, *out]], low, high)
                draws = near.draw(self.rng, DRAWS)
                point[name] = self._value(name, float(draws[np.argmax(near.log_density(draws) - far.log_density(draws))]))
            out.append(point)
        return out


class _Mixture:
    """Normal kernels cut to [low, high], one of them as broad as the range."""

    def __init__(self, points: list[float], low: float, high: float):
        self.low, self.high = low, high
        x = np.sort(np.array(points, dtype=float))
        edges = np.concatenate([[low], x, [high]])
        width = np.maximum(edges[1:-1] - edges[:-2], edges[2:] - edges[1:-1])
        span = high - low
        self.centre = np.append(x, (low + high) / 2)
        self.width = np.append(np.clip(width, span / min(100.0, 1.0 + len(x)), span), span)

    def draw(self, rng, count: int) -> np.ndarray:
        out: list[float] = []
        while len(out) < count:
            k = rng.integers(0, len(self.centre), count)
            x = rng.normal(self.centre[k], self.width[k])
            out += x[(x >= self.low) & (x <= self.high)].tolist()
        return np.array(out[:count])

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x[:, None] - self.centre) / self.width
        phi = lambda v: 0.5 * (1 + np.vectorize(math.erf)(v / math.sqrt(2)))
        inside = phi((self.high - self.centre) / self.width) - phi((self.low - self.centre) / self.width)
        return np.log((np.exp(-0.5 * z * z) / (self.width * math.sqrt(2 * math.pi) * inside)).mean(axis=1) + 1e-300)


def sequential_search(spark: SparkSession, cohorts: list[str], model: str, ranges: dict[str, tuple], losses, iterations: int = 30, batch: int = 10,
                      seed: int = 42) -> DataFrame:
    """All trials as ``TRIAL_SCHEMA`` rows. ``losses`` takes a list of points and returns {cohort: [loss, ...]}.

    Every batch is shared out among the cohorts' own proposals, and every cohort is told the losses of all its points."""
    samplers = {c: ParzenSampler(ranges, seed + k) for k, c in enumerate(cohorts)}
    told: dict[str, list[tuple[dict, float]]] = {c: [] for c in cohorts}
    rows, done = [], 0
    for step in range(-(-iterations // batch)):
        wanted = min(batch, iterations - done)
        points: list[dict] = []
        for k, c in enumerate(cohorts):
            points += samplers[c].propose(told[c], wanted // len(cohorts) + (k < wanted % len(cohorts)))
        found = losses(points)
        for c in cohorts:
            for i, (point, loss) in enumerate(zip(points, found[c])):
                told[c].append((point, loss))
                rows.append((c, model, step, done + i, {k: str(v) for k, v in point.items()}, loss))
        done += len(points)
    return small_frame(spark, rows, TRIAL_SCHEMA)
