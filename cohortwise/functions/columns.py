"""Column expressions. All stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division where a zero denominator means a missing value."""
    return F.try_divide(numerator, denominator)


def clamp_lower(value: Column, floor: float = 0.0) -> Column:
    """Lower bound that keeps NULL (``greatest`` would replace it)."""
    return F.when(value < F.lit(floor), F.lit(floor)).otherwise(value)


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def half_up(value: Column) -> Column:
    """``round`` of a double to a whole number, halves away from zero, without Spark's way through a decimal's text."""
    near = F.rint(value)
    off = value - near
    return near + F.when((off == 0.5) & (value > 0), 1.0).when((off == -0.5) & (value < 0), -1.0).otherwise(0.0)


def equal_width_code(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Right-closed equal-width bin number, -1 for a missing value.

    Every inner edge below the value adds one. A constant column has no width,
    so all of its values fall in the middle bin.
    """
    width = (high - low) / F.lit(float(bins))
    code = F.lit(0)
    for step in range(1, bins):
        code = code + F.when(value > low + F.lit(float(step)) * width, 1).otherwise(0)
    return (
        F.when(value.isNull(), -1)
        .when(low == high, (bins - 1) // 2)
        .otherwise(code)
        .cast("int")
    )


def histogram_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Left-closed equal-width bin number; the last bin also holds the maximum.

    Without a width all values fall in the middle bin; a missing value has no bin.
    """
    position = F.floor(ratio((value - low) * F.lit(float(bins)), high - low))
    place = F.when(low == high, F.lit(bins // 2)).otherwise(F.least(position, F.lit(bins - 1)))
    return F.when(value.isNotNull(), place).cast("int")


def min_max(value: Column, low: Column, high: Column) -> Column:
    """(x - min) / (max - min); 0 for a constant column, NULL for a missing value."""
    return F.when(high == low, value - low).otherwise((value - low) / (high - low))


def z_score(value: Column, mean: Column, deviation: Column) -> Column:
    """(x - mean) / population deviation; 0 for a constant column."""
    return F.when(deviation == 0, value - mean).otherwise((value - mean) / deviation)


def yeo_johnson(value: Column, power: Column | float) -> Column:
    """Yeo-Johnson transform of ``value`` for one power (Yeo and Johnson, 2000)."""
    lam = F.lit(float(power)) if isinstance(power, (int, float)) else power
    up, down = value + 1.0, F.lit(1.0) - value
    return (
        F.when((value >= 0) & (lam == 0), F.log1p(value))
        .when(value >= 0, F.try_divide(F.pow(up, lam) - 1.0, lam))
        .when(lam == 2, -F.log1p(-value))
        .otherwise(-F.try_divide(F.pow(down, F.lit(2.0) - lam) - 1.0, F.lit(2.0) - lam))
    )


def stable_bucket(digest: Column, start: int, buckets: int) -> Column:
    """Bucket from eight hex digits of a row's digest; independent of partitioning."""
    return (F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint") % F.lit(buckets)).cast("int")


def title(name: Column) -> Column:
    """Display name of a column: underscores to blanks, words capitalised."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))
