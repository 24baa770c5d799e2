import math

import numpy as np

from cohortwise.models import registry, train
from cohortwise.models.sampler import ParzenSampler, sequential_search
from test_growth import data, table  # noqa: F401

RANGES = {"rate": ("log", 1e-4, 1.0), "depth": ("int", 2, 12), "share": ("uniform", 0.0, 1.0), "rounds": ("hundreds", 100, 1500)}


def loss(p):
    return (math.log10(p["rate"]) + 2.3) ** 2 + ((p["depth"] - 5) / 3) ** 2 + 4 * (p["share"] - 0.8) ** 2 + ((p["rounds"] - 700) / 500) ** 2


def best_of(seed, sequential):
    sampler = ParzenSampler(RANGES, seed)
    if not sequential:
        return min(map(loss, sampler.random(60)))
    trials = []
    for _ in range(10):
        trials += [(p, loss(p)) for p in sampler.propose(trials, 6)]
    return min(v for _, v in trials)


def test_beats_random_draws_over_ten_seeds():
    pairs = [(best_of(seed, True), best_of(seed, False)) for seed in range(10)]
    assert sum(a < b for a, b in pairs) >= 8
    assert np.mean([a for a, _ in pairs]) < 0.5 * np.mean([b for _, b in pairs])


def test_points_stay_in_their_ranges():
    sampler = ParzenSampler(RANGES, 1)
    trials = [(p, loss(p)) for p in sampler.random(12)] + [(sampler.random(1)[0], None), (sampler.random(1)[0], float("nan"))]
    for p in sampler.propose(trials, 40):
        assert 1e-4 <= p["rate"] <= 1 and 2 <= p["depth"] <= 12 and isinstance(p["depth"], int) and 0 <= p["share"] <= 1
        assert p["rounds"] % 100 == 0 and 100 <= p["rounds"] <= 1500


def test_trials_table(spark):
    found = sequential_search(spark, ["a", "b"], "m", RANGES, lambda points: {c: [loss(p) for p in points] for c in "ab"}, 15, 6).collect()
    assert len(found) == 30 and {r.batch for r in found} == {0, 1, 2} and sorted({r.trial for r in found}) == list(range(15))


def test_search_of_a_grown_model(data):  # noqa: F811
    rows = train.sequential_trials(data, registry.tree_models()[registry.TREE], {"max_depth": ("int", 1, 12), "min_samples_leaf": ("int", 1, 60)}, 16, 8).collect()
    for c in ("a", "b"):
        mine = [r for r in rows if r.cohort == c]
        assert len(mine) == 16 and [r.trial for r in mine if r.chosen] == [min(mine, key=lambda r: (r.loss, r.trial)).trial]
        assert min(r.loss for r in mine if r.batch) <= 1.02 * min(r.loss for r in mine if not r.batch)
