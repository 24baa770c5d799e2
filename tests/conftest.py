import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[4]").appName("tests")
               .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("scratch")))
               .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def vehicles(spark):
    """Synthetic table in the shape of the documented input: two cohorts, 600 rows."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(7)
    n = 600
    electric = np.arange(n) % 2 == 0
    pick = lambda a, b, c, d: np.where(electric, rng.uniform(a, b, n), rng.uniform(c, d, n))
    pdf = pd.DataFrame({
        "vehicle_type": np.where(electric, "EV", "ICE"),
        "energy_consumption": pick(13, 15, 6, 10),
        "co2_emissions_g_per_km": pick(-5, 5, 150, 175),
        "maintenance_cost_annual": pick(5_000, 90_000, 10_000, 190_000),
        "cost_per_km": pick(0.12, 0.15, 0.30, 0.35),
        "energy_storage_capacity": pick(40, 100, 40, 80),
        "mileage_km": pick(20_000, 250_000, 20_000, 330_000),
        "acceleration_0_100_kph_sec": pick(6, 8, 8, 10),
        "torque_Nm": pick(250, 350, 150, 250),
        "lifespan_years": rng.integers(5, 20, n).astype(float),
    })
    pdf.loc[5, "energy_storage_capacity"] = np.nan
    return spark.createDataFrame(pdf)
