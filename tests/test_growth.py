"""Trees from shared histograms against plain versions of themselves."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortwise import VEHICLES
from cohortwise.models import growth, registry, train
from cohortwise.models.growth import FINAL, Growth, Grower
from cohortwise.models.train import Search, train_models, training_data
from cohortwise.operators.split import with_split
from cohortwise.shipping import ship
from cohortwise.sources import sinks

NAMES = ["x", "z", "w"]


@pytest.fixture(scope="module")
def table(spark):
    ship(spark)
    rng = np.random.default_rng(4)
    n = 900
    pdf = pd.DataFrame({"cohort": np.where(np.arange(n) % 3 == 0, "a", "b"), "k": np.arange(n), "x": rng.normal(50, 10, n),
                        "z": rng.integers(0, 6, n).astype(float), "w": rng.uniform(-1, 1, n)})
    pdf["y"] = np.where(pdf.x > 52, 30, 0) + 5 * pdf.z * (pdf.w > 0) + rng.normal(0, 2, n) + 7
    return with_split(spark.createDataFrame(pdf).withColumn("row_key", F.md5(F.col("k").cast("string"))))


@pytest.fixture(scope="module")
def data(table):
    return training_data(table, "y", {"a": NAMES, "b": NAMES}, VEHICLES)


@pytest.fixture(scope="module")
def pdf(data):
    return data.rows.toPandas()


def codes_of(grown, cohort, rows, bins=growth.BINS):
    return np.stack([np.searchsorted(grown.edges[cohort, f, bins], rows[f].to_numpy(), side="left") for f in NAMES])


def plain_tree(codes, rest, depth, least, l2):
    """Nested tuples (feature, bin, left, right) or a value, by trying every split of every node."""
    value = rest.sum() / (len(rest) + l2)
    score = lambda r: r.sum() ** 2 / (len(r) + l2)
    best = (1e-9, None)
    if depth:
        for f in range(len(codes)):
            for b in range(codes[f].max()):
                left = codes[f] <= b
                if min(left.sum(), (~left).sum()) >= least:
                    gain = score(rest[left]) + score(rest[~left]) - score(rest)
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, b, left))
    if best[1] is None:
        return value
    f, b, left = best[1]
    return f, b, plain_tree(codes[:, left], rest[left], depth - 1, least, l2), plain_tree(codes[:, ~left], rest[~left], depth - 1, least, l2)


def predict(tree, codes):
    if not isinstance(tree, tuple):
        return np.full(codes.shape[1], tree)
    f, b, left, right = tree
    return np.where(codes[f] <= b, predict(left, codes), predict(right, codes))


@pytest.mark.parametrize("whole, local, collect, cells", [(10**6, 0, 0, 200), (0, 40, 10**7, 10**6), (0, 4096, 10**7, 10**6), (240, 0, 0, 200)])
def test_single_trees_equal_a_plain_search(data, pdf, monkeypatch, whole, local, collect, cells):
    """Any mixture of whole fits, passes, groups that finish nodes and sums that groups add up grows the same trees."""
    for name, value in {"WHOLE_ROWS": whole, "LOCAL_ROWS": local, "COLLECT_BYTES": collect, "CELLS": cells, "FAN_IN": 2}.items():
        monkeypatch.setattr(growth, name, value)
    wanted = [Growth(depth=2), Growth(depth=5), Growth(depth=5, least=20), Growth(depth=30, least=7)]
    grower = Grower(data.rows, "y", "cohort", data.chosen)
    grown = grower.grow(wanted)
    grower.release()
    for c in ("a", "b"):
        rows = pdf[pdf.cohort == c]
        codes, y = codes_of(grown, c, rows), rows.y.to_numpy()
        learn = (rows.split == "train").to_numpy()
        for i, g in enumerate(wanted):
            for fold in (FINAL, 1):
                mine = learn & (rows.fold != fold).to_numpy()
                base = y[mine].mean()
                tree = plain_tree(codes[:, mine], y[mine] - base, g.depth, g.least, 0.0)
                for split, at in (("train", learn), ("test", ~learn)) if fold == FINAL else (("cv", learn & ~mine),):
                    error = base + predict(tree, codes[:, at]) - y[at]
                    want = (at.sum(), np.abs(error).mean(), np.sqrt((error**2).mean()), 1 - (error**2).sum() / ((y[at] - y[at].mean()) ** 2).sum())
                    assert grown.scores[c, i, fold, split] == pytest.approx(want, rel=1e-9), (c, g, fold, split)
    assert grower.passes <= 30 or cells == 200  # the levels of the deepest tree, whatever the number of fits


@pytest.mark.parametrize("whole", [0, 10**6])
def test_boosting_equals_a_plain_loop(data, pdf, monkeypatch, whole):
    monkeypatch.setattr(growth, "REFRESH", 3)
    monkeypatch.setattr(growth, "WHOLE_ROWS", whole)
    wanted = [Growth(rounds=4, depth=2, step=0.3, l2=1.5), Growth(rounds=8, depth=2, step=0.3, l2=1.5)]
    grown = data.grower.grow(wanted)
    rows = pdf[pdf.cohort == "b"]
    codes, y, learn = codes_of(grown, "b", rows), rows.y.to_numpy(), (rows.split == "train").to_numpy()
    score = np.full(len(y), y[learn].mean())
    for r in range(8):
        score = score + 0.3 * predict(plain_tree(codes[:, learn], (y - score)[learn], 2, 1, 1.5), codes)
        if r in (3, 7):
            assert grown.scores["b", int(r == 7), FINAL, "test"][1] == pytest.approx(np.abs(score - y)[~learn].mean(), rel=1e-9)


def test_passes_and_whole_fits_agree_for_every_shape(data, monkeypatch):
    wanted = [replace(registry.tree_models("small")[name].growth, rounds=3, depth=3) for name in (registry.SUBSAMPLED, registry.SLOW, registry.HISTOGRAM)]
    whole = data.grower.grow(wanted)
    monkeypatch.setattr(growth, "WHOLE_ROWS", 0)
    passes = data.grower.grow(wanted)
    assert whole.scores.keys() == passes.scores.keys()
    for key, values in whole.scores.items():
        assert values == pytest.approx(passes.scores[key], rel=1e-9), key
    for key, fit in whole.fits.items():
        assert [(t.feature, t.split, t.left) for t in fit.trees] == [(t.feature, t.split, t.left) for t in passes.fits[key].trees]


def losses(data, spec, rounds):
    grown = data.grower.grow([spec.grown(maxIter=r) for r in rounds], folds=False)
    return [grown.scores["b", i, FINAL, "train"][2] for i in range(len(rounds))], grown


def test_profiles_differ_in_algorithm_and_learn_steadily(data):
    models = registry.tree_models("small")
    seen = {}
    for name in (registry.BOOSTING, registry.SUBSAMPLED, registry.SLOW, registry.HISTOGRAM):
        found, grown = losses(data, models[name], [1, 2, 3, 6, 12])
        assert all(a > b for a, b in zip(found, found[1:])), name
        seen[name] = grown.fits["b", 4].trees
    by_level = lambda tree: {level: {(f, s) for f, s, down, n in zip(tree.feature, tree.split, tree.left, tree.level) if down and n == level} for level in set(tree.level)}
    assert all(len(pairs) <= 1 for t in seen[registry.SLOW] for pairs in by_level(t).values())
    assert any(len(pairs) > 1 for t in seen[registry.BOOSTING] for pairs in by_level(t).values())
    used = [{f for f, down in zip(t.feature, t.left) if down} for t in seen[registry.SUBSAMPLED]]
    assert all(len(u) <= 2 for u in used) and set().union(*used) == {0, 1, 2}
    assert max(sum(1 for down in t.left if not down) for t in seen[registry.HISTOGRAM]) <= 31


def test_best_first_takes_the_best_leaf_each_time():
    tree = growth.Tree()
    a = tree.children(0, 0, 3, 10.0)
    b = tree.children(a, 1, 2, 4.0)
    c = tree.children(a + 1, 1, 1, 6.0)
    tree.children(c, 2, 5, 5.0)
    tree.children(b, 0, 1, 3.0)
    assert [sorted(g for g in tree.best_first(n).gain if g) for n in (1, 2, 3, 4, 5)] == [[], [10.0], [6.0, 10.0], [5.0, 6.0, 10.0], [4.0, 5.0, 6.0, 10.0]]
    cut = tree.best_first(3)
    assert cut.left[0] and sum(1 for x in cut.left if not x) == 3


def test_models_score_like_their_growth_and_survive_saving(data, tmp_path):
    trained = train_models(data, [registry.TREE, registry.BOOSTING, registry.SLOW, registry.HISTOGRAM], "small")
    test = data.rows.where("cohort = 'a' and split = 'test'")
    for r in trained.results.where("cohort = 'a'").collect():
        assert r.status == "ok" and r.base_cv_mae_mean > 0
        sinks.save_model(trained.models["a", r.model], str(tmp_path / r.model.replace(" ", "")), "y", "a")
        loaded = sinks.load_model(str(tmp_path / r.model.replace(" ", "")), "y", "a")
        mae = loaded.transform(test).agg(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0]
        assert mae == pytest.approx(r.test_mae, rel=1e-9)
        gapless = loaded.transform(test.withColumn("x", F.lit(None).cast("double")))
        assert gapless.where("prediction is null").count() == 0
    shares = trained.importances.groupBy("cohort", "model").agg(F.sum("importance").alias("s")).collect()
    assert len(shares) == 8 and all(r.s == pytest.approx(1.0) for r in shares)


def test_search_picks_the_candidate_with_the_best_folds(data):
    search = Search(iterations=30)
    trained = train_models(data, [registry.TREE], search=search).results.collect()
    assert len(search.points(registry.TREE)) == 30
    for c in ("a", "b"):
        table = train.multi_metric_search(data, c, registry.tree_models()[registry.TREE], search.spark_candidates(registry.TREE)).collect()
        row = next(r for r in trained if r.cohort == c)
        assert row.tuned_cv_mae_mean == pytest.approx(min(t.cv_mae for t in table), rel=1e-12) and row.base_cv_mae_mean is not None


def test_unusual_rows(spark, table):
    """No split, no fold, one value, infinities, a cohort without training rows."""
    odd = (table.withColumn("split", F.when(F.col("k") % 10 > 0, F.col("split"))).withColumn("fold", F.when(F.col("k") % 7 > 0, F.col("fold")))
           .withColumn("z", F.lit(1.0)).withColumn("x", F.when(F.col("k") % 50 == 3, float("inf")).otherwise(F.col("x")))
           .withColumn("split", F.when((F.col("cohort") == "a") & (F.col("split") == "train"), "test").otherwise(F.col("split"))))
    grower = Grower(odd, "y", "cohort", {"a": NAMES, "b": NAMES, "none": NAMES, "empty": []})
    grown = grower.grow([Growth(depth=4)])
    assert {c for c, _ in grown.fits} == {"b"}
    counts = {r.split: r["count"] for r in odd.where("cohort = 'b'").groupBy("split").count().collect()}
    assert {s: v[0] for (c, i, f, s), v in grown.scores.items() if f == FINAL} == counts
    assert all(1 not in t.feature for t in grown.fits["b", 0].trees for _ in [0] if any(t.left))


def test_width_bins(data, pdf):
    grown = Grower(data.rows, "y", "cohort", data.chosen, growth.width_edges).grow([Growth(depth=1, bins=8)], folds=False)
    x = pdf[(pdf.cohort == "a") & (pdf.split == "train")].x
    assert grown.edges["a", "x", 8] == pytest.approx([x.min() + k * ((x.max() - x.min()) / 8) for k in range(1, 8)])


@pytest.fixture(scope="module")
def coarse(table):
    """Few distinct rows, so that every cohort has cells of several rows."""
    rows = table.withColumns({"x": F.floor(F.col("x") / 10) * 10, "w": F.floor(F.col("w") * 2), "z": F.floor(F.col("z") / 2)})
    return training_data(rows.withColumns({c: F.col(c).cast("double") for c in NAMES}), "y", {"a": NAMES, "b": NAMES}, VEHICLES)


@pytest.mark.parametrize("score, part", [(10**6, 10**6), (200, 90)])
def test_cells_grow_the_same_trees_in_a_few_passes(coarse, monkeypatch, score, part):
    """Trees, boosting of every shape and samples of rows: from cells as in passes, without a pass per level and round."""
    monkeypatch.setattr(growth, "WHOLE_ROWS", 0)
    monkeypatch.setattr(growth, "HERE_CELLS", 100)
    wanted = [Growth(depth=3), Growth(depth=9), Growth(depth=9, least=6), Growth(rounds=4, depth=2, step=0.3), Growth(rounds=2, depth=2, step=0.3),
              Growth(rounds=3, depth=3, step=0.3, rows=0.7), Growth(rounds=3, depth=3, step=0.3, rows=0.9, columns=0.6, l2=1.0), Growth(rounds=2, depth=3, step=0.3, rows=0.7, seed=7),
              Growth(rounds=3, depth=3, step=0.2, shape="symmetric", l2=2.0), Growth(rounds=3, depth=4, step=0.2, shape="leaves", leaves=5, bins=255)]
    grown, passes = {}, {}
    for kind, share in (("passes", 10**9), ("cells", 2)):
        monkeypatch.setattr(growth, "CELL_SHARE", share)
        monkeypatch.setattr(growth, "SCORE_BYTES", score)
        monkeypatch.setattr(growth, "PART_ROWS", part)
        grower = Grower(coarse.rows, "y", "cohort", coarse.chosen)
        grown[kind] = grower.grow(wanted)
        passes[kind] = grower.passes
        grower.release()
    assert grown["cells"].scores.keys() == grown["passes"].scores.keys() and len(grown["cells"].scores) == 2 * len(wanted) * 7
    for key, values in grown["cells"].scores.items():
        assert values == pytest.approx(grown["passes"].scores[key], rel=1e-9), key
    for key, fit in grown["cells"].fits.items():
        other = grown["passes"].fits[key]
        for a, b in zip(grown["cells"].trees(*key, wanted[key[1]]), grown["passes"].trees(*key, wanted[key[1]]), strict=True):
            assert len(a[0]) == len(b[0]) and np.sort(a[3]) == pytest.approx(np.sort(b[3]), rel=1e-9, abs=1e-12), (key, other)
    assert score < 10**6 or passes["cells"] <= 6 < passes["passes"]


def test_cells_count_rows_without_split_or_fold(spark, coarse, monkeypatch):
    """Test rows in cells of their own, rows without split or fold, and a cohort whose training rows share a fold."""
    rows = coarse.rows.withColumns({"x": F.when(F.col("split") == "test", 7.0).otherwise(F.col("x")), "split": F.when(F.rand(1) < 0.9, F.col("split")),
                                    "fold": F.when(F.col("cohort") == "a", 9).when(F.rand(2) < 0.9, F.col("fold"))}).localCheckpoint()
    monkeypatch.setattr(growth, "WHOLE_ROWS", 0)
    found = []
    for share in (10**9, 2):
        monkeypatch.setattr(growth, "CELL_SHARE", share)
        grower = Grower(rows, "y", "cohort", coarse.chosen)
        found.append(grower.grow([Growth(depth=6), Growth(rounds=2, depth=2, rows=0.8)]))
        grower.release()
        assert set(grower.grow([Growth(depth=1)], folds=False, cohorts=["b"]).fits) == {("b", 0)}
    assert found[0].scores.keys() == found[1].scores.keys() and {s for *_, s in found[0].scores} == {"train", "test", "cv", None}
    assert all(v == pytest.approx(found[1].scores[k], rel=1e-9) for k, v in found[0].scores.items())


def test_chunks_of_rounds_grow_the_same_boosting(coarse, monkeypatch):
    """Rounds of whole fits, and from cells in chunks of one round that reach a group one after the other."""
    wanted = [Growth(rounds=7, depth=3, step=0.3, rows=0.7), Growth(rounds=5, depth=2, step=0.3)]
    found = []
    for whole, chunk in ((10**6, 10**6), (0, 1)):
        for name, value in {"WHOLE_ROWS": whole, "CELL_SHARE": 2, "CHUNK_BYTES": chunk}.items():
            monkeypatch.setattr(growth, name, value)
        grower = Grower(coarse.rows, "y", "cohort", coarse.chosen)
        found.append(grower.grow(wanted).scores)
        grower.release()
    assert found[0].keys() == found[1].keys() and len(found[0]) == 2 * 2 * 7
    for key, values in found[0].items():
        assert found[1][key] == pytest.approx(values, rel=1e-9), key


@pytest.mark.parametrize("change", [{}, {"rows": 0.7}, {"shape": "symmetric", "l2": 2.0}, {"shape": "leaves", "leaves": 4}])
def test_whole_fits_grow_the_same_rounds_from_rows_and_from_cells(monkeypatch, change):
    rng = np.random.default_rng(3)
    codes, label = rng.integers(0, 4, (3, 800)).astype(np.uint8), rng.normal(0, 1, 800)
    label += codes[0] * codes[1]
    role, key = rng.integers(0, 2, 800).astype(np.int8), rng.integers(0, 2**62, 800).astype(np.uint64)
    found, trees = [], []
    for share in (10**9, 4):
        monkeypatch.setattr(growth, "CELL_SHARE", share)
        assert (growth._alike(codes) is None) == (share > 4)
        fit = growth.Fit(0, "a", Growth(rounds=6, depth=3, step=0.3, **change), FINAL, 6, 3, 0, float(label[role == 0].mean()), int((role == 0).sum()))
        found.append(list(growth.grow_fit(fit, codes, label, role, key, 4, ((3, 3), (6, 3)))))
        trees.append([(t.feature, t.split, t.left) for t in fit.trees])
    assert trees[0] == trees[1] and len(found[0]) == 4
    for a, b in zip(*found, strict=True):
        assert b == pytest.approx(a, rel=1e-9, abs=1e-9)


def test_forests_are_the_mean_of_trees_over_bootstrap_samples(coarse, monkeypatch):
    """Whole fits, cells and passes against trees that are grown one by one over repeated rows."""
    wanted = [Growth(rounds=3, depth=4, bagged=True), Growth(rounds=5, depth=4, bagged=True)]
    rows, found = coarse.rows.toPandas(), {}
    for kind, whole, share in (("whole", 10**6, 2), ("cells", 0, 2), ("passes", 0, 10**9)):
        monkeypatch.setattr(growth, "WHOLE_ROWS", whole)
        monkeypatch.setattr(growth, "CELL_SHARE", share)
        grower = Grower(coarse.rows, "y", "cohort", coarse.chosen)
        found[kind] = grower.grow(wanted)
        grower.release()
    key = {r.row_key: r.k for r in coarse.rows.select("row_key", F.xxhash64("row_key").alias("k")).collect()}
    mine = rows[rows.cohort == "b"]
    codes, y, learn = codes_of(found["whole"], "b", mine), mine.y.to_numpy(), (mine.split == "train").to_numpy()
    keys = np.array([key[k] for k in mine.row_key], dtype=np.int64).view(np.uint64)
    for fold in (FINAL, 2):
        at = learn & (mine.fold != fold).to_numpy()
        base, trees = y[at].mean(), []
        for r in range(5):
            many = np.repeat(np.flatnonzero(at), growth._times(keys[at], wanted[0].row_seed(r)))
            trees.append(predict(plain_tree(codes[:, many], y[many] - base, 4, 1, 0.0), codes))
        held = ~learn if fold == FINAL else learn & ~at
        for i, rounds in enumerate((3, 5)):
            error = (base + np.mean(trees[:rounds], axis=0) - y)[held]
            for kind, grown in found.items():
                n, mae, rmse, _ = grown.scores["b", i, fold, "test" if fold == FINAL else "cv"]
                assert (n, mae, rmse) == pytest.approx((held.sum(), np.abs(error).mean(), np.sqrt((error**2).mean())), rel=1e-9), (kind, fold, rounds)
    for kind, grown in found.items():
        assert grown.scores.keys() == found["whole"].scores.keys(), kind


def test_bootstrap_samples_count_rows_by_poissons_law():
    times = growth._times(np.random.default_rng(0).integers(0, 2**63, 200_000).astype(np.uint64), 7)
    assert times.mean() == pytest.approx(1.0, abs=0.01) and times.var() == pytest.approx(1.0, abs=0.02) and (times == 0).mean() == pytest.approx(np.exp(-1), abs=0.005)
