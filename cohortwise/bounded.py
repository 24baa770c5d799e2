"""Guards for the places where rows reach the driver or are broadcast.

Statistics tables hold one row per cohort (times features, folds or models),
so they do not grow with the data. These helpers check that bound at run time
instead of assuming it.
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_STATISTICS_ROWS = 200_000
MAX_BROADCAST_ROWS = 10_000


class TooManyRows(ValueError):
    """A table expected to be small is not."""


def collect_bounded(df: DataFrame, limit: int = MAX_STATISTICS_ROWS) -> list[Row]:
    """Collect a statistics table, refusing (not truncating) beyond ``limit`` rows."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise TooManyRows(f"expected at most {limit} statistics rows; group by fewer keys")
    return rows


_ARROW = {
    T.StringType(): pa.string(), T.DoubleType(): pa.float64(), T.FloatType(): pa.float32(),
    T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.BooleanType(): pa.bool_(),
    T.MapType(T.StringType(), T.StringType()): pa.map_(pa.string(), pa.string()),
}


def small_frame(spark: SparkSession, rows: Iterable[tuple], schema: T.StructType | str) -> DataFrame:
    """A local relation from driver-side statistics; needs no Python workers to scan."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    columns = list(zip(*rows)) or [()] * len(schema)
    plain = lambda v: list(v.items()) if isinstance(v, dict) else v
    arrays = [pa.array([plain(v) for v in values], _ARROW[f.dataType]) for values, f in zip(columns, schema)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=schema.names), schema)


def attach(df: DataFrame, stats: DataFrame, on: list[str]) -> DataFrame:
    """Join per-group statistics onto the rows of ``df``.

    The statistics are evaluated once. Up to MAX_BROADCAST_ROWS groups they are
    broadcast as a local relation; beyond that a plain shuffle join is left to
    adaptive execution, which also splits hot keys.
    """
    spark = df.sparkSession
    rows = stats.limit(MAX_BROADCAST_ROWS + 1).collect()
    if len(rows) <= MAX_BROADCAST_ROWS:
        small = small_frame(spark, rows, stats.schema)
        return df.join(F.broadcast(small), on, "left")
    return df.join(stats, on, "left")


#: Most bytes of an Arrow batch that is bounded by its rows alone, and of a value.
NARROW_BYTES, VALUE_BYTES = 64_000_000, 16
_BATCH_ROWS, _BATCH_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
_narrow_lock = threading.Lock()
_narrow_uses: dict[SparkSession, list] = {}  # uses, and the setting before them


@contextmanager
def narrow_batches(df: DataFrame) -> Iterator[None]:
    """Inside, Arrow batches of the session are bounded by their rows alone, if that many rows of ``df`` are small.

    Spark measures a batch after every row; for rows of some numbers this takes longer than all the rest of their way to
    Python. For actions whose rows sent to Python are those of ``df`` only: the setting holds where a plan is run.
    """
    spark = df.sparkSession
    rows, limit = int(spark.conf.get(_BATCH_ROWS)), spark.conf.get(_BATCH_BYTES)
    if not 0 < rows * len(df.columns) * VALUE_BYTES <= NARROW_BYTES:
        yield
        return
    with _narrow_lock:
        uses = _narrow_uses.setdefault(spark, [0, limit])
        uses[0] += 1
        spark.conf.set(_BATCH_BYTES, str(2**31 - 1))
    try:
        yield
    finally:
        with _narrow_lock:
            uses[0] -= 1
            if not uses[0]:
                spark.conf.set(_BATCH_BYTES, _narrow_uses.pop(spark)[1])


_local_scratch: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: ``spark.checkpoint.dir`` where set.

    Only a local session without that setting gets a temporary folder, one per application.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if spark.conf.get("spark.master", "local").startswith("local"):
        application = spark.sparkContext.applicationId
        if application not in _local_scratch:
            _local_scratch[application] = tempfile.mkdtemp(prefix="cohortwise-")
        return _local_scratch[application]
    raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as Parquet into the shared scratch folder and read it back.

    Later passes prune columns on a columnar table, and a lost executor costs
    re-reading files instead of recomputing the joins behind them.
    """
    spark = df.sparkSession
    path = os.path.join(scratch_dir(spark), f"{tag}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a materialized table that nothing reads any more."""
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.scratch)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
