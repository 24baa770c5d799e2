"""Reading input tables and binding other star schemas to the same roles."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortwise.config import CohortConfig, ORIGINAL_FEATURES, TARGET_COMPONENTS, VEHICLES
from cohortwise.functions.columns import half_up, nan_to_null

VEHICLE_SCHEMA = T.StructType(
    [T.StructField("vehicle_type", T.StringType())]
    + [T.StructField(name, T.DoubleType()) for name in TARGET_COMPONENTS + ORIGINAL_FEATURES]
)

# Binding of the line-item star schema: F rows play the electric cohort.
UNITS = CohortConfig(electric=frozenset({"F"}), corr_thresholds={"F": 0.02})


def read_table(spark: SparkSession, path: str, schema: T.StructType = VEHICLE_SCHEMA) -> DataFrame:
    """Read a CSV (with header) or Parquet table with an explicit schema."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    # The header decides the column order; Spark fills the declared schema by name.
    header = spark.read.option("header", True).csv(path).columns
    by_name = {field.name: field for field in schema}
    ordered = T.StructType([by_name.get(name, T.StructField(name, T.StringType())) for name in header])
    return spark.read.schema(ordered).option("header", True).csv(path)


def as_cohort_table(df: DataFrame, cohort_column: str = "vehicle_type",
                    config: CohortConfig = VEHICLES) -> DataFrame:
    """Name the cohort column, turn NaN into NULL and add a row key from the content.

    Exact copies of a row share a key, hence a split: a copy never sits in both
    training and test data.
    """
    numeric = [c for c in config.numeric_columns if c in df.columns]
    cleaned = [nan_to_null(F.col(c).cast("double")).alias(c) for c in numeric]
    content = F.concat_ws("|", F.col(cohort_column), *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in numeric])
    return (
        df.where(F.col(cohort_column).isNotNull())
        .select(F.col(cohort_column).alias(config.cohort), F.md5(content).alias(config.row_key), *cleaned)
    )


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Scans of up to this many splits may be spread over the cores; larger ones never are.
SMALL_SPLITS = 8


def spread(df: DataFrame, scan: DataFrame, *keys: str) -> DataFrame:
    """Hash ``df`` over all cores when ``scan`` has a handful of splits, fewer than cores.

    A table of more than ``SMALL_SPLITS`` splits is returned as it is, on a cluster of any size: no shuffle is added
    at scale. Rows are the same either way.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = scan.rdd.getNumPartitions()
    return df.repartition(cores, *keys) if splits < cores and splits <= SMALL_SPLITS else df


def _unit_key() -> Column:
    cents = half_up(F.col("l_extendedprice") * 100).cast("bigint")
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents)




def _roles() -> dict[str, tuple[str, Column]]:
    return {
        "mileage_km": ("lineitem", F.col("l_extendedprice")),
        "energy_consumption": ("lineitem", F.col("l_quantity")),
        "co2_emissions_g_per_km": ("customer", F.col("c_acctbal")),
        "maintenance_cost_annual": ("orders", F.col("o_totalprice")),
        "cost_per_km": ("lineitem", F.col("l_tax") + 0.0),
        "energy_storage_capacity": ("lineitem", F.col("l_discount") + 0.0),
        "acceleration_0_100_kph_sec": ("part", F.col("p_size").cast("double")),
        "torque_Nm": ("part", F.col("p_retailprice")),
        "lifespan_years": ("lineitem", F.col("l_linenumber").cast("double")),
    }


def tables_of(roles: Iterable[str]) -> set[str]:
    """The tables that carry ``roles``; names that are not roles are ignored."""
    known = _roles()
    return {known[r][0] for r in roles if r in known}


def units(spark: SparkSession, sf_dir: str, roles: Iterable[str] | None = None) -> DataFrame:
    """The line-item star schema as a cohort table.

    Only the tables that carry the requested roles are joined. Joins are outer: a line without its order, customer
    or part stays with missing values, so the rows never depend on the roles asked for. Orders and customers meet
    first, so the large line-item side is shuffled once per remaining key; join strategies and the
    splitting of hot keys are left to adaptive execution.
    """
    known = _roles()
    wanted = list(known) if roles is None else [r for r in known if r in set(roles)]
    tables = tables_of(wanted)
    scan = lines = parquet(spark, sf_dir, "lineitem")
    if tables & {"orders", "customer"}:
        orders = parquet(spark, sf_dir, "orders")
        if "customer" in tables:
            customer = parquet(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
            orders = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
        lines = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    if "part" in tables:
        part = parquet(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
        lines = lines.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    return spread(lines, scan, "l_orderkey", "l_linenumber").select(
        F.col("l_linestatus").alias("cohort"),
        F.md5(_unit_key()).alias("row_key"),
        *[known[r][1].alias(r) for r in wanted],
    )


def part_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their part as the cohort: as many cohorts as there are parts."""
    scan = parquet(spark, sf_dir, "lineitem")
    return spread(scan, scan, "l_orderkey", "l_linenumber").select(
        F.col("l_partkey").cast("string").alias("cohort"), F.md5(_unit_key()).alias("row_key"), F.col("l_quantity").alias("quantity"),
        (F.col("l_tax") + 0.0).alias("tax"), (F.col("l_discount") + 0.0).alias("discount"))


def event_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a cohort table: one numeric column, five cohorts, heavy tails."""
    scan = parquet(spark, sf_dir, "events")
    return spread(scan, scan, "event_id").select(
        F.col("event_type").alias("cohort"),
        F.md5(F.col("event_id").cast("string")).alias("row_key"),
        F.col("value"),
    )


def embedding_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as a wide cohort table with one column per dimension; vectors of different lengths are an error."""
    scan = parquet(spark, sf_dir, "embeddings")
    sizes = scan.agg(F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most")).first()
    if sizes.least != sizes.most:
        raise ValueError(f"embeddings have {sizes.least} to {sizes.most} dimensions")
    width = max(sizes.most or 0, 0)
    return spread(scan, scan, "vec_id").select(
        F.col("label").cast("string").alias("cohort"),
        F.md5(F.col("vec_id").cast("string")).alias("row_key"),
        *[F.col("embedding")[i].cast("double").alias(f"e{i:02d}") for i in range(width)],
    )
