"""What an analysis is about: column roles, targets and thresholds."""

from __future__ import annotations

from dataclasses import dataclass, field

# Column names of the input table and of the three targets.
ORIGINAL_FEATURES = (
    "co2_emissions_g_per_km",
    "cost_per_km",
    "energy_storage_capacity",
    "acceleration_0_100_kph_sec",
    "torque_Nm",
    "lifespan_years",
    "maintenance_cost_annual",
)
TARGETS = ("maintenance_cost_annual", "efficiency", "mileage_km")
TARGET_COMPONENTS = ("mileage_km", "energy_consumption")


@dataclass(frozen=True)
class CohortConfig:
    """Column roles of one input table.

    ``leakage="reference"`` keeps features derived from the target (only the
    target's own components go); ``"strict"`` drops every feature whose lineage
    contains the target.
    """

    cohort: str = "cohort"
    row_key: str = "row_key"
    ratio_name: str = "efficiency"
    ratio_numerator: str = "mileage_km"
    ratio_denominator: str = "energy_consumption"
    originals: tuple[str, ...] = ORIGINAL_FEATURES
    components: tuple[str, ...] = TARGET_COMPONENTS
    targets: tuple[str, ...] = TARGETS
    clamped: tuple[str, ...] = ("co2_emissions_g_per_km",)
    electric: frozenset = frozenset({"EV"})
    corr_thresholds: dict = field(default_factory=lambda: {"EV": 0.02})
    default_corr_threshold: float = 0.03
    variance_threshold: float = 0.01
    collinearity_threshold: float = 0.85
    max_features: int = 20
    bins: int = 5
    leakage: str = "reference"
    outlier_scope: str = "pooled"
    fit_on: str = "all"

    @property
    def numeric_columns(self) -> tuple[str, ...]:
        return self.components + self.originals

    def corr_threshold(self, cohort: str) -> float:
        return self.corr_thresholds.get(cohort, self.default_corr_threshold)


VEHICLES = CohortConfig()
