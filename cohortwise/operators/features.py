"""Engineered features as a declarative list with lineage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.bounded import attach
from cohortwise.config import CohortConfig
from cohortwise.functions.columns import equal_width_code, ratio


@dataclass(frozen=True)
class Feature:
    """``scope`` says which cohorts have it: all, electric, or combustion (the others)."""

    name: str
    kind: str
    inputs: tuple[str, ...]
    scope: str = "all"

    def applies_to(self, cohort: str, config: CohortConfig) -> bool:
        return self.scope == "all" or (self.scope == "electric") == (cohort in config.electric)


# The engineered features, in order of appearance in the data.
FEATURES = (
    Feature("power_efficiency", "ratio", ("torque_Nm", "acceleration_0_100_kph_sec")),
    Feature("storage_per_torque", "ratio", ("energy_storage_capacity", "torque_Nm")),
    Feature("cost_efficiency", "ratio", ("cost_per_km", "torque_Nm")),
    Feature("maintenance_per_year", "ratio", ("maintenance_cost_annual", "lifespan_years")),
    Feature("maintenance_per_torque", "ratio", ("maintenance_cost_annual", "torque_Nm")),
    Feature("lifespan_torque_ratio", "product", ("lifespan_years", "torque_Nm")),
    Feature("eco_efficiency", "inverse_plus_one", ("co2_emissions_g_per_km",), "electric"),
    Feature("green_performance", "ratio_plus_one", ("torque_Nm", "co2_emissions_g_per_km"), "electric"),
    Feature("emission_intensity", "ratio", ("co2_emissions_g_per_km", "torque_Nm"), "combustion"),
    Feature("emission_per_storage", "ratio", ("co2_emissions_g_per_km", "energy_storage_capacity"), "combustion"),
    Feature("torque_category_num", "bin", ("torque_Nm",)),
    Feature("acceleration_category_num", "bin", ("acceleration_0_100_kph_sec",)),
    Feature("torque_squared", "square", ("torque_Nm",)),
    Feature("acceleration_squared", "square", ("acceleration_0_100_kph_sec",)),
    Feature("cost_squared", "square", ("cost_per_km",)),
    Feature("torque_x_lifespan", "product", ("torque_Nm", "lifespan_years")),
    Feature("cost_x_maintenance", "product", ("cost_per_km", "maintenance_cost_annual")),
    Feature("storage_x_lifespan", "product", ("energy_storage_capacity", "lifespan_years")),
    Feature("log_maintenance", "log", ("maintenance_cost_annual",)),
    Feature("log_torque", "log", ("torque_Nm",)),
    Feature("log_storage", "log", ("energy_storage_capacity",)),
    Feature("normalized_torque", "share_of_max", ("torque_Nm",)),
    Feature("normalized_cost", "share_of_max", ("cost_per_km",)),
    Feature("normalized_maintenance", "share_of_max", ("maintenance_cost_annual",)),
)


def _low(column: str) -> Column:
    return F.col(f"__min_{column}")


def _high(column: str) -> Column:
    return F.col(f"__max_{column}")


_KINDS = {
    "ratio": lambda a, b, _: ratio(F.col(a), F.col(b)),
    "product": lambda a, b, _: F.col(a) * F.col(b),
    "inverse_plus_one": lambda a, _: ratio(F.lit(1.0), F.col(a) + 1.0),
    "ratio_plus_one": lambda a, b, _: ratio(F.col(a), F.col(b) + 1.0),
    "square": lambda a, _: F.col(a) * F.col(a),
    "log": lambda a, _: F.log1p(a),
    "share_of_max": lambda a, _: ratio(F.col(a), _high(a)),
    "bin": lambda a, config: equal_width_code(F.col(a), _low(a), _high(a), config.bins),
}


def feature_column(feature: Feature, config: CohortConfig) -> Column:
    """Expression of one feature; NULL outside the cohorts it belongs to."""
    value = _KINDS[feature.kind](*feature.inputs, config)
    if feature.scope == "all":
        return value
    electric = F.col(config.cohort).isin(*sorted(config.electric))
    return F.when(electric if feature.scope == "electric" else ~electric, value)


def range_columns(features=FEATURES) -> list[str]:
    """Inputs whose per-cohort minimum and maximum a feature needs."""
    return sorted({f.inputs[0] for f in features if f.kind in ("bin", "share_of_max")})


def value_ranges(df: DataFrame, columns: list[str], config: CohortConfig, fit_on: str = "all") -> DataFrame:
    """Per-cohort minimum and maximum: one map-side aggregation, one row per cohort."""
    source = df.where(F.col("split") == "train") if fit_on == "train" else df
    return source.groupBy(config.cohort).agg(
        *[F.min(c).alias(f"__min_{c}") for c in columns],
        *[F.max(c).alias(f"__max_{c}") for c in columns],
    )


def lineage(feature: str, config: CohortConfig, features=FEATURES) -> set[str]:
    """Input columns a feature is computed from (itself included)."""
    if feature == config.ratio_name:
        return {feature, config.ratio_numerator, config.ratio_denominator}
    for f in features:
        if f.name == feature:
            return {feature, *f.inputs}
    return {feature}


def leaks(feature: str, target: str, config: CohortConfig, features=FEATURES) -> bool:
    return bool(lineage(feature, config, features) & lineage(target, config, features))


def engineered_names(cohort: str | None, target: str, config: CohortConfig, features=FEATURES) -> list[str]:
    """Engineered candidates of a cohort; the ratio itself counts when it is not the target."""
    names = [] if target == config.ratio_name else [config.ratio_name]
    names += [f.name for f in features if cohort is None or f.applies_to(cohort, config)]
    if config.leakage == "strict":
        names = [n for n in names if not leaks(n, target, config, features)]
    return names


def candidate_names(cohort: str | None, target: str, config: CohortConfig, features=FEATURES) -> list[str]:
    """Originals and engineered features without the target and its components."""
    barred = {target, *config.components}
    return [n for n in config.originals if n not in barred] + engineered_names(cohort, target, config, features)


def engineer(df: DataFrame, target: str, config: CohortConfig, features=FEATURES,
             ranges: DataFrame | None = None) -> DataFrame:
    """Add all engineered features in one projection and drop the target's components."""
    needed = range_columns(features)
    if ranges is None:
        ranges = value_ranges(df, needed, config, config.fit_on)
    joined = attach(df, ranges, [config.cohort])
    dropped = {c for c in config.components if c != target}
    kept = [c for c in df.columns if c not in dropped]
    return joined.select(*kept, *[feature_column(f, config).alias(f.name) for f in features])
