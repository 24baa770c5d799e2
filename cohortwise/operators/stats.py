"""Descriptive statistics, correlations, histograms and box-plot summaries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortwise.bounded import attach, collect_bounded, materialize, narrow_batches, small_frame
from cohortwise.functions.columns import histogram_bin, nan_to_null, ratio
from cohortwise.operators.batches import grouped, matrix
from cohortwise.operators.quantiles import quantiles


def stacked(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(by..., feature, value): one row per column, produced and consumed inside one stage."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*by, F.inline(cells))


def profile(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(by..., feature, n_rows, n, mean, var_pop, minimum, maximum) in one aggregation.

    Columns are stacked first: a few hundred side-by-side aggregates would fall
    out of code generation, seven aggregates keyed by column name do not.
    """
    return stacked(df, columns, by).groupBy(*by, "feature").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("n"),
        F.avg("value").alias("mean"), F.var_pop("value").alias("var_pop"),
        F.min("value").alias("minimum"), F.max("value").alias("maximum"),
    )


def describe(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """Count, mean, median, sample deviation, minimum and maximum per group."""
    x = F.col(column)
    moments = df.groupBy(*by).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
        F.min(x).alias("minimum"), F.max(x).alias("maximum"),
    )
    medians = quantiles(df, [column], [0.5], by).select(*by, F.col("value").alias("median"))
    return moments.join(F.broadcast(medians), list(by))


def missing_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    return profile(df, columns, by).select(*by, "feature", "n_rows", (F.col("n_rows") - F.col("n")).alias("n_missing"))


def medians(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(by..., feature, value): exact medians."""
    return quantiles(df, columns, [0.5], by).select(*by, "feature", "value")


# --- correlations ---------------------------------------------------------

_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def centers_and_scales(stats: DataFrame, cohort: str) -> dict[str, dict[str, tuple[float, float]]]:
    """Per cohort and feature a (shift, scale) that keeps sums of products well conditioned."""
    table: dict[str, dict[str, tuple[float, float]]] = {}
    for r in collect_bounded(stats):
        if r.n == 0:
            shift, scale = 0.0, 1.0
        elif r.minimum == r.maximum:  # exactly constant: deviations are exactly zero
            shift, scale = r.minimum, 1.0
        else:
            shift, scale = r["mean"], float(np.sqrt(r.var_pop)) or 1.0
        table.setdefault(r[cohort], {})[r.feature] = (shift, scale)
    return table


def _complete_sums(z: np.ndarray) -> list[np.ndarray]:
    """Sums for all pairs of a batch without missing values: one matrix product."""
    k = z.shape[1]
    spread = lambda v: np.repeat(v[:, None], k, axis=1)
    total, square = spread(z.sum(0)), spread((z * z).sum(0))
    return [np.full((k, k), float(len(z))), total, total.T, square, square.T, z.T @ z]


def _pairwise_sums(z: np.ndarray) -> list[np.ndarray]:
    """The same over the rows where both columns of a pair are present."""
    present = ~np.isnan(z)
    z = np.where(present, z, 0.0)
    m = present.astype("float64")
    square = z * z
    return [m.T @ m, z.T @ m, m.T @ z, square.T @ m, m.T @ square, z.T @ z]


def pair_sums(df: DataFrame, columns: Sequence[str], by: Sequence[str],
              shifts: dict[str, dict[str, tuple[float, float]]]) -> DataFrame:
    """Additive sums for every pair of columns over the rows where both are present.

    (by..., a, b, n, sx, sy, sxx, syy, sxy) with a <= b. ``by[0]`` is the cohort;
    values are shifted and scaled per cohort. Each task folds its batches into a
    few k-by-k matrices with matrix products and emits one row per pair and
    group, so the shuffle carries statistics, never rows.
    """
    by, columns = list(by), list(columns)
    k = len(columns)
    upper = np.triu_indices(k)
    affine = {g: (np.array([f.get(c, (0.0, 1.0))[0] for c in columns]),
                  np.array([f.get(c, (0.0, 1.0))[1] for c in columns])) for g, f in shifts.items()}

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict[tuple, list[np.ndarray]] = {}
        for batch in batches:
            matrix = batch[columns].to_numpy(dtype="float64", na_value=np.nan)
            for key, index in batch.groupby(by, dropna=False, sort=False).indices.items():
                key = key if isinstance(key, tuple) else (key,)
                shift, scale = affine[key[0]]
                z = (matrix[index] - shift) / scale
                sums = _complete_sums(z) if not np.isnan(z).any() else _pairwise_sums(z)
                held = state.get(key)
                state[key] = sums if held is None else [h + s for h, s in zip(held, sums)]
        for key, sums in state.items():
            out = {name: [value] * len(upper[0]) for name, value in zip(by, key)}
            out |= {"i": upper[0].astype("int32"), "j": upper[1].astype("int32")}
            out |= {name: s[upper] for name, s in zip(_SUMS, sums)}
            yield pd.DataFrame(out)

    schema = T.StructType(
        [df.schema[b] for b in by] + [T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType())]
        + [T.StructField(s, T.DoubleType()) for s in _SUMS])
    partial = df.where(F.col(by[0]).isNotNull()).select(*by, *[F.col(c).cast("double").alias(c) for c in columns]).mapInPandas(fold, schema)
    names = F.array(*[F.lit(c) for c in columns])
    return (
        partial.groupBy(*by, "i", "j").agg(*[F.sum(s).alias(s) for s in _SUMS])
        .select(*by, names[F.col("i")].alias("a"), names[F.col("j")].alias("b"), "i", "j", *_SUMS)
    )


def correlation_from_sums() -> Column:
    """Pearson correlation; NULL where a side does not vary."""
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    vx = F.col("sxx") - ratio(sx * sx, n)
    vy = F.col("syy") - ratio(sy * sy, n)
    varies = (vx > n * 1e-14) & (vy > n * 1e-14)
    r = ratio(F.col("sxy") - ratio(sx * sy, n), F.sqrt(vx * vy))
    return F.when(varies, F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)))


#: Columns up to which one pass gives moments and products: a task's sums are then at most 130 KB a cohort.
TOGETHER = 64
_TOGETHER = ("cohort string, i int, j int, n_rows bigint, n bigint, mean double, var_pop double, minimum double, maximum double, "
             "pairs double, sx double, sy double, sxx double, syy double, sxy double")


class _PairSums:
    """Sums of a group's pairs of columns about a shift of its own, over the rows where both are present."""

    def __init__(self, shift: np.ndarray, rows: float, low: np.ndarray, high: np.ndarray, sums: np.ndarray):
        self.shift, self.rows, self.low, self.high, self.sums = shift, rows, low, high, sums

    @classmethod
    def of(cls, values: np.ndarray, shift: np.ndarray | None = None) -> "_PairSums":
        low, high = np.fmin.reduce(values, axis=0), np.fmax.reduce(values, axis=0)
        if shift is None:
            present = ~np.isnan(values)
            mean = np.where(present, values, 0.0).sum(0) / np.maximum(present.sum(0), 1)
            shift = np.where(low == high, low, mean)  # a constant deviates by exactly nothing
            shift = np.where(np.isfinite(shift), shift, 0.0)
        z = values - shift
        n, sx, _, sxx, _, sxy = _complete_sums(z) if not np.isnan(z).any() else _pairwise_sums(z)
        return cls(shift, float(len(values)), low, high, np.stack([n, sx, sxx, sxy]))

    def about(self, shift: np.ndarray) -> "_PairSums":
        d, (n, sx, sxx, sxy) = (self.shift - shift)[:, None], self.sums
        moved = np.stack([n, sx + d * n, sxx + 2 * d * sx + d * d * n, sxy + d * sx.T + d.T * sx + d * d.T * n])
        return _PairSums(shift, self.rows, self.low, self.high, moved)

    def __add__(self, other: "_PairSums") -> "_PairSums":
        """Both about the same shift."""
        return _PairSums(self.shift, self.rows + other.rows, np.fmin(self.low, other.low), np.fmax(self.high, other.high), self.sums + other.sums)


def _merged_pairs(cohort: str | None, parts: list[_PairSums]) -> pd.DataFrame:
    """``_TOGETHER`` rows of a cohort: about the means, in deviations."""
    n = sum(np.diag(p.sums[0]) for p in parts)
    total = sum(np.diag(p.sums[0]) * p.shift + np.diag(p.sums[1]) for p in parts)
    low, high = (f.reduce([getattr(p, side) for p in parts], axis=0) for f, side in ((np.fmin, "low"), (np.fmax, "high")))
    center = np.where(low == high, low, total / np.maximum(n, 1))
    center = np.where((n > 0) & np.isfinite(center), center, 0.0)
    whole = parts[0].about(center)
    for p in parts[1:]:
        whole = whole + p.about(center)
    m, sx, sxx, sxy = whole.sums
    gap = np.diag(sx) / np.maximum(n, 1)
    variance = np.maximum(np.diag(sxx) / np.maximum(n, 1) - gap * gap, 0.0)
    scale = np.sqrt(np.where((low == high) | ~(variance > 0), 1.0, variance))
    i, j = np.triu_indices(len(n))
    known = lambda v: np.where(n > 0, v, np.nan)[i]
    return pd.DataFrame({
        "cohort": [cohort] * len(i), "i": i, "j": j, "n_rows": int(whole.rows), "n": n[i].astype("int64"), "mean": known(center + gap),
        "var_pop": known(variance), "minimum": low[i], "maximum": high[i], "pairs": m[i, j], "sx": (sx / scale[:, None])[i, j],
        "sy": (sx / scale[:, None])[j, i], "sxx": (sxx / scale[:, None] ** 2)[i, j], "syy": (sxx / scale[:, None] ** 2)[j, i],
        "sxy": (sxy / np.outer(scale, scale))[i, j]})


def moments_and_pairs(df: DataFrame, columns: Sequence[str], cohort: str) -> DataFrame:
    """``_TOGETHER`` rows from one pass: moments of column ``i`` and sums of every pair i <= j, a row per cohort and pair.

    Each task folds its batches about the means of its first one; groups bring the tasks' sums to the cohort's means. NaN counts as missing.
    """
    columns = list(columns)
    k = len(columns)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, _PairSums] = {}
        for batch in batches:
            values = matrix(batch, 1)
            for (key,), rows in grouped(batch, 1):
                found = _PairSums.of(values[rows], held[key].shift if key in held else None)
                held[key] = held[key] + found if key in held else found
        if held:
            packed = [np.concatenate([p.shift, [p.rows], p.low, p.high, p.sums.ravel()]).tobytes() for p in held.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(packed, pa.binary())], ["cohort", "sums"])

    def unpack(data: bytes) -> _PairSums:
        v = np.frombuffer(data)
        return _PairSums(v[:k], float(v[k]), v[k + 1:2 * k + 1], v[2 * k + 1:3 * k + 1], v[3 * k + 1:].reshape(4, k, k))

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        return _merged_pairs(rows["cohort"].iloc[0], [unpack(b) for b in rows["sums"]])

    wide = df.select(F.col(cohort).alias("cohort"), *[F.col(c).cast("double").alias(f"v{n}") for n, c in enumerate(columns)])
    with narrow_batches(wide):
        partial = materialize(wide.mapInArrow(fold, "cohort string, sums binary"), "partial-pairs")
    found = partial.groupBy("cohort").applyInPandas(merge, _TOGETHER)
    names = F.array(*[F.lit(c) for c in columns])
    missing = {c: nan_to_null(F.col(c)) for c in ("mean", "var_pop", "minimum", "maximum")}
    return found.withColumns({"a": names[F.col("i")], "b": names[F.col("j")], **missing}).withColumnRenamed("cohort", cohort)


def profile_of(together: DataFrame, cohort: str) -> DataFrame:
    """``profile`` rows."""
    return together.where("i = j").select(cohort, F.col("a").alias("feature"), "n_rows", "n", "mean", "var_pop", "minimum", "maximum")


def pairs_of(together: DataFrame, cohort: str) -> DataFrame:
    """``correlation_pairs`` rows."""
    return together.where((F.col("i") < F.col("j")) & F.col(cohort).isNotNull()).select(
        cohort, "a", "b", F.col("pairs").alias("n"), "sx", "sy", "sxx", "syy", "sxy").select(
        cohort, "a", "b", F.col("n").cast("bigint").alias("n"), correlation_from_sums().alias("corr"))


def correlation_pairs(df: DataFrame, columns: Sequence[str], cohort: str, stats: DataFrame | None = None) -> DataFrame:
    """(cohort, a, b, n, corr) for every pair a < b in the given column order."""
    if stats is None and len(columns) <= TOGETHER:
        return pairs_of(moments_and_pairs(df, columns, cohort), cohort)
    shifts = centers_and_scales(profile(df, columns, [cohort]) if stats is None else stats, cohort)
    sums = pair_sums(df, columns, [cohort], shifts).where(F.col("i") < F.col("j"))
    return sums.select(cohort, "a", "b", F.col("n").cast("bigint").alias("n"), correlation_from_sums().alias("corr"))


def target_correlations(pairs: DataFrame, target: str, cohort: str) -> DataFrame:
    """(cohort, feature, corr) of every column with the target."""
    other = F.when(F.col("a") == target, F.col("b")).when(F.col("b") == target, F.col("a"))
    return pairs.select(cohort, other.alias("feature"), "corr").where(F.col("feature").isNotNull())


def correlation_matrix(pairs: DataFrame, columns: Sequence[str], cohort: str) -> DataFrame:
    """(cohort, row, col, i, j, corr) on and below the diagonal."""
    position = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(i))])
    cohorts = pairs.select(cohort).distinct()
    diagonal = cohorts.select(cohort, F.explode(F.array(*[F.lit(c) for c in columns])).alias("row")) \
        .select(cohort, "row", F.col("row").alias("col"), F.lit(1.0).alias("corr"))
    below = pairs.select(cohort, F.col("b").alias("row"), F.col("a").alias("col"), "corr")
    return diagonal.unionByName(below).select(
        cohort, "row", "col", position[F.col("row")].alias("i"), position[F.col("col")].alias("j"), "corr")


def strength_buckets(correlations: DataFrame, cohort: str, moderate_above: dict[str, float],
                     default: float, strong_above: float = 0.05) -> DataFrame:
    """How many features correlate strongly, moderately and weakly, per cohort."""
    limit = F.lit(default)
    for name, value in moderate_above.items():
        limit = F.when(F.col(cohort) == name, F.lit(value)).otherwise(limit)
    r = F.abs("corr")
    return correlations.groupBy(cohort).agg(
        F.count_if(r > strong_above).alias("strong"),
        F.count_if((r > limit) & (r <= strong_above)).alias("moderate"),
        F.count_if(r <= limit).alias("weak"),
    )


def compare_cohort_correlations(correlations: DataFrame, cohort: str, first: str, second: str) -> DataFrame:
    """Correlation of each common feature in two cohorts side by side."""
    one = correlations.where(F.col(cohort) == first).select("feature", F.col("corr").alias("corr_first"))
    two = correlations.where(F.col(cohort) == second).select("feature", F.col("corr").alias("corr_second"))
    return one.join(two, "feature").withColumn("gap", F.col("corr_first") - F.col("corr_second"))


# --- distributions --------------------------------------------------------

def histogram(df: DataFrame, column: str, cohort: str, bins: int) -> DataFrame:
    """Equal-width histogram per cohort, empty bins included: (cohort, bin, low, high, n, density).

    A constant column gets half a unit on each side. Missing values, NaN and rows without cohort do not count.
    """
    values = df.select(cohort, nan_to_null(F.col(column).cast("double")).alias("value")).where(F.col("value").isNotNull() & F.col(cohort).isNotNull())
    ranges = values.groupBy(cohort).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("total"))
    aside = F.when(F.col("lo") == F.col("hi"), 0.5).otherwise(0.0)
    ranges = ranges.withColumns({"lo": F.col("lo") - aside, "hi": F.col("hi") + aside})
    ranges = small_frame(df.sparkSession, collect_bounded(ranges), ranges.schema)
    counts = attach(values, ranges, [cohort]).groupBy(
        cohort, histogram_bin(F.col("value"), F.col("lo"), F.col("hi"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    binned = every.join(counts, [cohort, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))
    width = (F.col("hi") - F.col("lo")) / float(bins)
    return binned.select(
        cohort, "bin", (F.col("lo") + F.col("bin") * width).alias("low"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), "n",
        ratio(F.col("n").cast("double"), F.col("total") * width).alias("density"),
    )


def box_plot(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """Quartiles, whiskers at the last value within 1.5 ranges, and outlier count per group."""
    by = list(by)
    long = quantiles(df, [column], [0.25, 0.5, 0.75], by)
    at = lambda p: F.max(F.when(F.col("p") == p, F.col("value")))
    quartiles = long.groupBy(*by).agg(at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3"))
    spread = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    value = F.col(column)
    inside = value.between(F.col("q1") - spread, F.col("q3") + spread)
    return attach(df.select(*by, column), quartiles, by).groupBy(*by, "q1", "median", "q3").agg(
        F.min(F.when(inside, value)).alias("whisker_low"),
        F.max(F.when(inside, value)).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
    )


def cohort_mean_gap(df: DataFrame, columns: Sequence[str], cohort: str, first: str, second: str) -> DataFrame:
    """Means of two cohorts, percent difference and the higher one, per column."""
    means = df.groupBy().agg(*[
        F.struct(F.lit(c).alias("feature"),
                 F.avg(F.when(F.col(cohort) == first, F.col(c))).alias("mean_first"),
                 F.avg(F.when(F.col(cohort) == second, F.col(c))).alias("mean_second")).alias(c)
        for c in columns])
    return means.select(F.inline(F.array(*[F.col(c) for c in columns]))).select(
        "feature", "mean_first", "mean_second",
        ((ratio(F.col("mean_first"), F.col("mean_second")) - 1.0) * 100.0).alias("pct_difference"),
        F.when(F.col("mean_first") > F.col("mean_second"), first).otherwise(second).alias("higher"),
    )
