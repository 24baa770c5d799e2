"""Exact linear-interpolation quantiles without gathering a group in one task.

``percentile`` keeps every distinct value of a group in one hash map, and even a
sketch is merged by one task per group. Here values are counted in bins: each
task sends some thousand bin counts per group and column that spans a few powers
of ten, never more than it has values, the counts are added up by all reducers, and the running count names the bin that holds a
wanted rank. A bin also carries its smallest and largest value, so the next
count looks only between those two. Two or three counts narrow any rank to a
bin small enough to order, or to a single value.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortwise.bounded import collect_bounded, small_frame
from cohortwise.functions.columns import nan_to_null

SKETCH_ACCURACY = 10_000
MAX_ORDERED_VALUES = 1_000_000
BINS = 10_000
#: Bins per unit of log1p|x|, which stays below 710. So many that the bins of 100 million values between 900 and 2000 hold less than
#: MAX_ORDERED_VALUES each: they are ordered next, without a count in equal bins between.
_LOG_BINS = 256


@dataclass(frozen=True)
class _Bracket:
    """``inside`` values of a group's column lie in [low, high], ``below`` of them lie lower."""

    group_id: int
    feature: str
    low: float
    high: float
    below: int
    inside: int


def approximate_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float],
                          by: Sequence[str] = (), accuracy: int = SKETCH_ACCURACY) -> DataFrame:
    """Sketch quantiles in one pass: (by..., feature, p, value)."""
    probs = [float(p) for p in probabilities]
    sketch = [F.approx_percentile(c, F.lit(probs), F.lit(accuracy)).alias(c) for c in columns]
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.lit(p).alias("p"), F.col(c)[i].alias("value"))
        for c in columns for i, p in enumerate(probs)
    ])).alias("q")
    return df.groupBy(*by).agg(*sketch).select(*by, pairs).select(*by, "q.*")


def quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float],
              by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles as (by..., feature, p, n, value); NULL where a group has no value.

    NaN is a missing value. Infinities are values at the ends; between them there is no quantile (NULL).
    """
    by, probs = list(by), [float(p) for p in probabilities]
    first = _first_count(df, list(columns), probs, by)
    groups: dict[tuple, int] = {}
    places: dict[tuple, tuple] = {}
    ranks: dict[_Bracket, set[int]] = {}
    for r in first:
        g = groups.setdefault(tuple(r[b] for b in by), len(groups))
        place = places.setdefault((g, r.feature, r.p), (r.n, r.position, {}))
        if r.rank is not None:
            place[2][r.rank] = None
            ranks.setdefault(_Bracket(g, r.feature, r.low, r.high, r.below, r.inside), set()).add(r.rank)
    group_schema = T.StructType([df.schema[b] for b in by] + [T.StructField("group_id", T.IntegerType())])
    lookup = small_frame(df.sparkSession, [key + (g,) for key, g in groups.items()], group_schema)
    found = _resolve(df, by, lookup, ranks)

    keys = list(groups)
    rows = []
    for (g, feature, p), (n, position, wanted) in places.items():
        value = None
        if wanted:
            a, b = found[g, feature, min(wanted)], found[g, feature, max(wanted)]
            value = _between(a, b, position - min(wanted))
        rows.append(keys[g] + (feature, p, n, value))
    schema = T.StructType([df.schema[b] for b in by] + list(T.StructType.fromDDL("feature string, p double, n bigint, value double")))
    return small_frame(df.sparkSession, rows, schema)


def _between(a: float, b: float, share: float) -> float | None:
    """Linear interpolation; an infinite end draws everything but the other end itself."""
    if a == b or share == 0:
        return a
    if math.isinf(a) or math.isinf(b):
        return None if math.isinf(a) and math.isinf(b) else a if math.isinf(a) else b
    return a + (b - a) * share


def _cells(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys..., feature, value): one row per column, produced and consumed inside one stage; ``feature`` is the column's place."""
    pairs = F.array(*[F.struct(F.lit(k).alias("feature"), nan_to_null(F.col(c).cast("double")).alias("value")) for k, c in enumerate(columns)])
    return df.select(*keys, F.inline(pairs))


def _count_bins(cells: DataFrame, keys: list[str], bin_number) -> DataFrame:
    """Counts, smallest and largest value per bin, with the running count ``upto``."""
    counted = cells.groupBy(*keys, bin_number.cast("int").alias("bin")).agg(
        F.count("value").alias("inside"), F.min("value").alias("low"), F.max("value").alias("high"))
    running = Window.partitionBy(*keys).orderBy("bin")
    return counted.withColumn("upto", F.sum("inside").over(running))


def _first_count(df: DataFrame, columns: list[str], probs: list[float], by: list[str]) -> list:
    """Sizes, ranks and the logarithmic bin of every rank; a missing rank marks an empty column."""
    keys = [*by, "feature"]
    value = F.col("value")
    # Infinities lie in bins of their own beyond those of the finite numbers.
    size = F.log1p(F.least(F.abs(value), F.lit(sys.float_info.max)))
    number = F.floor(F.signum(value) * (size * _LOG_BINS + F.when(F.abs(value) == float("inf"), 10.0).otherwise(0.0)))
    bins = _count_bins(_cells(df, columns, by), keys, number)
    total = bins.withColumn("n", F.sum("inside").over(Window.partitionBy(*keys)))
    asked = total.select("*", F.explode(F.array(*[F.lit(p) for p in probs])).alias("p"))
    asked = asked.withColumn("position", F.col("p") * (F.col("n") - 1))
    lower = F.floor("position").cast("bigint")
    both = F.array_distinct(F.array(lower, F.least(lower + 1, F.col("n") - 1)))
    none = F.array(F.lit(None).cast("bigint"))
    ranked = asked.select("*", F.explode(F.when(F.col("n") > 0, both).otherwise(none)).alias("rank"))
    holds = (F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("inside") <= F.col("rank"))
    hits = ranked.where(F.col("rank").isNull() | (holds & F.col("bin").isNotNull()))
    return collect_bounded(hits.select(
        *by, F.array(*[F.lit(c) for c in columns])[F.col("feature")].alias("feature"), "p", "n", "position", "rank", "low", "high", (F.col("upto") - F.col("inside")).alias("below"), "inside"))


def _resolve(df: DataFrame, by: list[str], lookup: DataFrame, ranks: dict[_Bracket, set[int]]) -> dict:
    """Value of every rank, as {(group_id, feature, rank): value}."""
    found = {}
    while ranks:
        single = {b: r for b, r in ranks.items() if b.low == b.high}
        found.update({(b.group_id, b.feature, k): b.low for b, wanted in single.items() for k in wanted})
        ranks = {b: r for b, r in ranks.items() if b not in single}
        # Neighbouring subnormal numbers have no bins between them: they are few values, however often they occur.
        few = {b: r for b, r in ranks.items() if b.inside <= MAX_ORDERED_VALUES or b.low / 2 == b.high / 2}
        many = {b: r for b, r in ranks.items() if b not in few}
        ranks = {}
        for part, ordered in ((few, True), (many, False)):
            if part:
                for b, k, r in _count_inside(df, by, lookup, part, ordered):
                    narrower = _Bracket(b.group_id, b.feature, r.low, r.high, b.below + r.upto - r.inside, r.inside)
                    ranks.setdefault(narrower, set()).add(k)
    return found


def _count_inside(df: DataFrame, by: list[str], lookup: DataFrame, ranks: dict[_Bracket, set[int]], ordered: bool):
    """(bracket, rank, hit): count values inside brackets, one by one or in equal bins."""
    spark = df.sparkSession
    brackets = list(ranks)
    low, high, value = F.col("from_value"), F.col("to_value"), F.col("value")
    columns = sorted({b.feature for b in brackets})
    table = small_frame(spark, [(i, b.group_id, columns.index(b.feature), b.low, b.high) for i, b in enumerate(brackets)],
                        "id int, group_id int, feature int, from_value double, to_value double")
    if by:
        named = lookup.select("group_id", *[F.col(b).alias(f"__{b}") for b in by])
        same = F.lit(True)
        for b in by:
            same = same & F.col(b).eqNullSafe(F.col(f"__{b}"))
        keyed = df.join(F.broadcast(named), same)
    else:
        keyed = df.withColumn("group_id", F.lit(0))
    cells = _cells(keyed, columns, ["group_id"])
    met = cells.join(F.broadcast(table), ["group_id", "feature"]).where(value.between(low, high))
    if ordered:
        counted = met.groupBy("id", "value").agg(F.count(F.lit(1)).alias("inside")) \
            .withColumn("upto", F.sum("inside").over(Window.partitionBy("id").orderBy("value"))) \
            .select("id", "inside", "upto", value.alias("low"), value.alias("high"))
    else:
        share = (value / 2 - low / 2) / (high / 2 - low / 2)  # halves: the difference of two doubles may overflow
        counted = _count_bins(met, ["id"], F.least(F.floor(share * BINS), F.lit(BINS - 1)))
    wanted = small_frame(spark, [(i, k, k - b.below) for i, b in enumerate(brackets) for k in ranks[b]],
                         "id int, rank bigint, inner_rank bigint")
    hits = counted.join(F.broadcast(wanted), "id").where(
        (F.col("upto") > F.col("inner_rank")) & (F.col("upto") - F.col("inside") <= F.col("inner_rank")))
    return [(brackets[r.id], r.rank, r) for r in collect_bounded(hits.select("id", "rank", "low", "high", "upto", "inside"))]
