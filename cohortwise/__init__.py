"""Cohort-wise regression analytics as Spark jobs."""

from cohortwise.config import CohortConfig, VEHICLES

__all__ = ["CohortConfig", "VEHICLES"]
