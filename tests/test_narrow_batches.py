"""Arrow batches of rows of numbers are bounded by their rows alone; the session's setting comes back."""

import numpy as np
import pandas as pd
import pytest

from cohortwise import bounded
from cohortwise.models import growth, linear, many
from cohortwise.operators import stats, transform
from cohortwise.operators.split import with_split

BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"cohort": ["a", "b"] * 200, "row_key": [f"{v:032x}" for v in rng.integers(1, 2**62, 400)], "x": rng.normal(size=400)})
    pdf["y"] = 2 * pdf.x + rng.normal(size=400)
    return with_split(spark.createDataFrame(pdf))


def test_every_pass_over_rows_is_free_of_the_byte_limit(spark, rows, monkeypatch):
    before, seen = spark.conf.get(BYTES), {}

    def spy(module, name):
        inner = getattr(module, name)

        def run(*args, **kwargs):
            seen.setdefault(module.__name__.split(".")[-1], []).append(spark.conf.get(BYTES))
            return inner(*args, **kwargs)
        monkeypatch.setattr(module, name, run)

    for module, name in ((stats, "materialize"), (linear, "materialize"), (linear, "collect_bounded"), (growth, "materialize"), (many, "materialize"), (transform, "collect_bounded")):
        spy(module, name)
    pairs = stats.correlation_pairs(rows, ["x", "y"], "cohort").collect()
    sums = linear.training_sums(rows.where("split = 'train'"), ["x"], "y", "cohort")
    fits = linear.fit_all(sums, {"a": ["x"], "b": ["x"]}, "y", [linear.LinearSpec("ols", "ols")])
    scores = linear.score(rows, "y", fits, "cohort").collect()
    growth.blocks_of(rows, "y", "cohort", {"a": ["x"], "b": ["x"]}, {("a", "x"): np.array([0.0]), ("b", "x"): np.array([0.0])})
    many.part_moments(rows, "y", ["x"], "cohort")
    transform.fit_powers(rows, ["x"], "cohort")
    free = str(2**31 - 1)
    assert seen["stats"] == seen["growth"] == [free] and seen["linear"] == [free, before, free]  # sums, their merge, scores
    assert seen["many"] == [free, before] and seen["transform"].count(free) == seen["transform"].count(before) + 1  # grids, and centers of all but the first
    assert spark.conf.get(BYTES) == before
    whole = rows.toPandas()
    for r in pairs:
        part = whole[whole.cohort == r.cohort]
        assert r.n == 200 and r["corr"] == pytest.approx(part.x.corr(part.y), rel=1e-9)
    assert sum(r.n for r in scores if r.stage == "cv") == (whole.split == "train").sum()


def test_nested_uses_failures_and_wide_rows_keep_the_setting(spark, rows):
    before = spark.conf.get(BYTES)
    with pytest.raises(ZeroDivisionError), bounded.narrow_batches(rows):
        with bounded.narrow_batches(rows):
            pass
        assert spark.conf.get(BYTES) == str(2**31 - 1)
        raise ZeroDivisionError
    assert spark.conf.get(BYTES) == before
    with bounded.narrow_batches(spark.range(1).selectExpr(*(f"id as c{k}" for k in range(500)))):
        assert spark.conf.get(BYTES) == before
