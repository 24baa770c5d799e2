"""Feature selection by correlation, variance and collinearity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.bounded import MAX_STATISTICS_ROWS, collect_bounded, discard, materialize, small_frame
from cohortwise.config import CohortConfig
from cohortwise.operators.features import candidate_names
from cohortwise.operators.stats import TOGETHER, correlation_pairs, medians, moments_and_pairs, pairs_of, profile, profile_of, target_correlations
from cohortwise.operators.tiles import WIDTH, block_profile, tiled_correlation_pairs


@dataclass
class Selection:
    """``table`` has one row per cohort and candidate; ``chosen`` the kept names in order;
    ``fills`` the medians of columns that miss values, for training to reuse."""

    table: DataFrame
    pairs: DataFrame
    chosen: dict[str, list[str]]
    fills: DataFrame


def filled_variance(stats: DataFrame, fills: DataFrame, cohort: str) -> DataFrame:
    """Population variance after median filling, from the moments of the present values."""
    n, total, fill = F.col("n"), F.col("n_rows"), F.coalesce(F.col("value"), F.lit(0.0))
    mean = F.coalesce(F.col("mean"), fill)
    filled_mean = (n * mean + (total - n) * fill) / total
    spread = n * (F.coalesce(F.col("var_pop"), F.lit(0.0)) + F.pow(mean - filled_mean, F.lit(2.0))) \
        + (total - n) * F.pow(fill - filled_mean, F.lit(2.0))
    joined = stats.join(fills, [cohort, "feature"], "left")
    return joined.select(cohort, "feature", F.when(n > 0, spread / total).alias("variance"))


def medians_where_missing(df: DataFrame, stats: DataFrame, cohort: str) -> DataFrame:
    """Medians of the columns that miss values somewhere; complete columns need none."""
    gaps = [r.feature for r in collect_bounded(stats.where("n < n_rows and n > 0").select("feature").distinct())]
    if not gaps:
        return small_frame(df.sparkSession, [], f"{cohort} string, feature string, value double")
    return medians(df, sorted(gaps), [cohort])


def greedy_prune(ranked: list[str], correlation: dict[tuple[str, str], float], limit: float, most: int) -> list[str]:
    """Walk names by falling relevance; keep one unless it is too close to a kept one."""
    kept: list[str] = []
    for name in ranked:
        if len(kept) == most:
            break
        closest = max((abs(correlation[name, other] or 0.0) for other in kept), default=0.0)
        if closest < limit:
            kept.append(name)
    return kept


def select_features(df: DataFrame, target: str, config: CohortConfig, features=None) -> Selection:
    """Statistics of all cohorts in one pass (two with many columns); only names are walked on the driver."""
    cohort = config.cohort
    names = features or candidate_names(None, target, config)
    source = df.where(F.col("split") == "train") if config.fit_on == "train" else df
    if len(names) < TOGETHER:
        found = materialize(moments_and_pairs(source, [*names, target], cohort), "moments")
        stats = small_copy(profile_of(found, cohort))
        fills = small_copy(medians_where_missing(source, stats, cohort))
        pairs = pairs_of(found, cohort)
        if stats.count() * (len(names) + 2) // 2 > MAX_STATISTICS_ROWS:
            return choose_by_rounds(pairs, stats, fills, target, config, names, explicit=features is not None)
        pairs = small_copy(pairs)
        discard(found)
        return choose(pairs, stats, fills, target, config, names, explicit=features is not None)
    wide = len(names) >= WIDTH
    stats = small_copy(block_profile(source, [*names, target], [cohort], WIDTH) if wide else profile(source, [*names, target], [cohort]))
    fills = small_copy(medians_where_missing(source, stats, cohort))
    pairs = tiled_correlation_pairs(source, [*names, target], cohort, stats, WIDTH) if wide else correlation_pairs(source, [*names, target], cohort, stats)
    if stats.count() * (len(names) + 2) // 2 > MAX_STATISTICS_ROWS:  # about as many pairs
        return choose_by_rounds(materialize(pairs, "pairs"), stats, fills, target, config, names, explicit=features is not None)
    pairs = small_copy(pairs)
    return choose(pairs, stats, fills, target, config, names, explicit=features is not None)


def small_copy(df: DataFrame) -> DataFrame:
    """Evaluate a statistics table once and keep it as a local relation."""
    return small_frame(df.sparkSession, collect_bounded(df), df.schema)


def choose(pairs: DataFrame, stats: DataFrame, fills: DataFrame, target: str, config: CohortConfig,
           names: list[str], explicit: bool = False) -> Selection:
    """Apply the thresholds and the greedy walk to the statistics tables."""
    cohort, spark = config.cohort, pairs.sparkSession
    judged = filled_variance(stats, fills, cohort).where(F.col("feature") != target).join(
        target_correlations(pairs, target, cohort), [cohort, "feature"], "left")
    cohorts = sorted({r[cohort] for r in collect_bounded(stats.select(cohort).distinct())})
    related: dict[str, dict] = {c: {} for c in cohorts}
    for r in collect_bounded(pairs):
        related[r[cohort]][r.a, r.b] = related[r[cohort]][r.b, r.a] = r["corr"]
    rows, chosen = [], {}
    by_cohort: dict[str, list] = {c: [] for c in cohorts}
    for r in collect_bounded(judged):
        by_cohort[r[cohort]].append(r)
    for c in cohorts:
        allowed = set(names) if explicit else set(candidate_names(c, target, config))
        entries = [r for r in by_cohort[c] if r.feature in allowed]
        passes = lambda r: ((r["corr"] is not None and abs(r["corr"]) > config.corr_threshold(c)),
                            (r.variance is not None and r.variance > config.variance_threshold))
        ranked = sorted((r for r in entries if all(passes(r))), key=lambda r: (-round(abs(r["corr"]), 12), r.feature))
        kept = greedy_prune([r.feature for r in ranked], related[c], config.collinearity_threshold, config.max_features)
        fallback = not kept
        chosen[c] = kept or ([n for n in config.originals if n in allowed] if not explicit else list(names))
        position = {name: i + 1 for i, name in enumerate(chosen[c])}
        for r in entries:
            related_enough, varies = passes(r)
            rows.append((c, r.feature, None if r["corr"] is None else abs(r["corr"]), r.variance, related_enough,
                         varies, r.feature in position, position.get(r.feature), fallback))
    table = small_frame(spark, rows, f"{cohort} string, feature string, abs_corr double, variance double, "
                        "passes_corr boolean, passes_variance boolean, selected boolean, position int, fallback boolean")
    return Selection(table, pairs, chosen, fills)


def independent_set(ranked: DataFrame, edges: DataFrame, cohort: str) -> DataFrame:
    """The greedy walk without a walk: names of ``ranked`` (cohort, feature, place) with no kept better neighbour.

    ``edges`` has (cohort, a, b) for every pair that is too close. In each round a name is kept if all its better neighbours
    are dropped, and dropped if one of them is kept; the best undecided name of every cohort is always decided, most rounds
    decide a large share. Every round is a join of the open edges, so no pair table meets the driver or one task.
    """
    spark = ranked.sparkSession
    place = lambda side: ranked.select(cohort, F.col("feature").alias(side), F.col("place").alias(f"{side}_place"))
    both = edges.join(place("a"), [cohort, "a"]).join(place("b"), [cohort, "b"])
    better = F.col("a_place") < F.col("b_place")
    pick = lambda x, y, name: F.when(better, F.col(x)).otherwise(F.col(y)).alias(name)
    open_ = materialize(both.select(cohort, pick("a", "b", "good"), pick("b", "a", "bad")).distinct(), "edges")
    kept = materialize(ranked.join(open_.select(cohort, F.col("bad").alias("feature")).distinct(), [cohort, "feature"], "left_anti").select(cohort, "feature"), "kept")
    parts, new = [kept], kept
    while not open_.isEmpty():
        dropped = open_.join(new.withColumnRenamed("feature", "good"), [cohort, "good"], "left_semi").select(cohort, F.col("bad").alias("gone")).distinct()
        # Edges whose worse end is decided, or whose better end is gone, ask nothing any more.
        left = (open_.join(dropped.withColumnRenamed("gone", "bad"), [cohort, "bad"], "left_anti")
                .join(dropped.withColumnRenamed("gone", "good"), [cohort, "good"], "left_anti"))
        after = materialize(left, "edges")
        dropped = materialize(dropped, "dropped")
        waiting = open_.select(cohort, "bad").distinct().join(dropped.withColumnRenamed("gone", "bad"), [cohort, "bad"], "left_anti")
        new = materialize(waiting.join(after.select(cohort, "bad").distinct(), [cohort, "bad"], "left_anti").withColumnRenamed("bad", "feature"), "kept")
        parts.append(new)
        discard(open_)
        discard(dropped)
        open_ = after
    discard(open_)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def choose_by_rounds(pairs: DataFrame, stats: DataFrame, fills: DataFrame, target: str, config: CohortConfig,
                     names: list[str], explicit: bool = False) -> Selection:
    """``choose`` for any number of columns: thresholds, ranks and pruning are joins; only the kept names reach the driver."""
    cohort, spark = config.cohort, pairs.sparkSession
    limit = F.lit(config.default_corr_threshold)
    for c, value in config.corr_thresholds.items():
        limit = F.when(F.col(cohort) == c, value).otherwise(limit)
    cohorts = sorted({r[cohort] for r in collect_bounded(stats.select(cohort).distinct())})
    allowed = names if explicit else None
    wanted = small_frame(spark, [(c, f) for c in cohorts for f in (allowed or candidate_names(c, target, config)) if f in set(names)], f"{cohort} string, feature string")
    judged = (filled_variance(stats, fills, cohort).where(F.col("feature") != target).join(wanted, [cohort, "feature"], "left_semi")
              .join(target_correlations(pairs, target, cohort), [cohort, "feature"], "left")
              .select(cohort, "feature", F.abs("corr").alias("abs_corr"), "variance", F.coalesce(F.abs("corr") > limit, F.lit(False)).alias("passes_corr"),
                      F.coalesce(F.col("variance") > config.variance_threshold, F.lit(False)).alias("passes_variance")))
    judged = materialize(judged, "judged")
    ranked = judged.where("passes_corr and passes_variance").select(cohort, "feature", F.struct((-F.round("abs_corr", 12)).alias("back"), F.col("feature").alias("name")).alias("place"))
    close = pairs.where(F.abs("corr") >= config.collinearity_threshold).select(cohort, "a", "b")
    kept = independent_set(ranked, close, cohort).join(ranked, [cohort, "feature"])
    order = Window.partitionBy(cohort).orderBy("place")
    first = kept.withColumn("position", F.row_number().over(order)).where(F.col("position") <= config.max_features).select(cohort, "feature", "position")
    chosen: dict[str, list[str]] = {c: [] for c in cohorts}
    for r in sorted(collect_bounded(first), key=lambda r: r["position"]):
        chosen[r[cohort]].append(r.feature)
    empty = [c for c in cohorts if not chosen[c]]
    for c in empty:
        chosen[c] = list(names) if explicit else [n for n in config.originals if n in set(candidate_names(c, target, config))]
    places = small_frame(spark, [(c, f, k + 1, c in empty) for c in cohorts for k, f in enumerate(chosen[c])], f"{cohort} string, feature string, position int, fallback boolean")
    table = judged.join(F.broadcast(places), [cohort, "feature"], "left").select(
        cohort, "feature", "abs_corr", "variance", "passes_corr", "passes_variance", F.col("position").isNotNull().alias("selected"), "position",
        F.col(cohort).isin(empty).alias("fallback") if empty else F.lit(False).alias("fallback"))
    return Selection(table, pairs, chosen, fills)
