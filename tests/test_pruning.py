import numpy as np
import pytest

from cohortwise.operators import select
from cohortwise.operators.select import greedy_prune, independent_set


@pytest.mark.parametrize("share", [0.05, 0.4])
def test_rounds_equal_the_greedy_walk(spark, share):
    rng = np.random.default_rng(9)
    names = [f"f{k:02}" for k in range(40)]
    nodes, edges, want = [], [], {}
    for c in ("a", "b"):
        ranked = [str(n) for n in rng.permutation(names)]
        close = {(a, b) for i, a in enumerate(names) for b in names[i + 1:] if rng.random() < share}
        nodes += [(c, f, k) for k, f in enumerate(ranked)]
        edges += [(c, *(pair if rng.random() < 0.5 else pair[::-1])) for pair in close] + [(c, names[0], "not ranked")]
        want[c] = set(greedy_prune(ranked, {(x, y): float((x, y) in close or (y, x) in close) for x in names for y in names}, 0.85, 10**6))
    got = independent_set(spark.createDataFrame(nodes, "cohort string, feature string, place int"), spark.createDataFrame(edges, "cohort string, a string, b string"), "cohort").collect()
    assert len(got) == len({(r.cohort, r.feature) for r in got})
    assert {c: {r.feature for r in got if r.cohort == c} for c in want} == want


def test_chains_and_nothing(spark):
    schema = "cohort string, feature string, place int"
    chain = spark.createDataFrame([("a", f"f{k}", k) for k in range(7)], schema)
    edges = spark.createDataFrame([("a", f"f{k}", f"f{k + 1}") for k in range(6)], "cohort string, a string, b string")
    assert sorted(r.feature for r in independent_set(chain, edges, "cohort").collect()) == ["f0", "f2", "f4", "f6"]
    assert independent_set(chain.limit(0), edges, "cohort").count() == 0 and independent_set(chain, edges.limit(0), "cohort").count() == 7


def test_selection_switches_beyond_the_driver_bound(spark, vehicles, monkeypatch):
    from cohortwise import VEHICLES
    from cohortwise.plans.runs import prepared_table
    from cohortwise.operators.features import engineer
    from cohortwise.sources.tables import as_cohort_table

    df = engineer(prepared_table(as_cohort_table(vehicles), "mileage_km", VEHICLES), "mileage_km", VEHICLES).persist()
    few = select.select_features(df, "mileage_km", VEHICLES)
    monkeypatch.setattr(select, "MAX_STATISTICS_ROWS", 100)
    many = select.select_features(df, "mileage_km", VEHICLES)
    assert many.chosen == few.chosen and many.table.columns == few.table.columns
    rounded = lambda s: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in s.table.fillna(-1).collect())
    assert rounded(many) == rounded(few)
    df.unpersist()
