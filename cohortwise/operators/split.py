"""Train/test split and folds from digits of the row key.

Both are pure column expressions: no shuffle, and the same rows land in the
same split whatever the partitioning or the retry of a lost task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.functions.columns import stable_bucket

FOLDS = 5
#: Column of a table whose split and fold are stored; trees sample rows by it.
CODE = "row_code"
TEST_PERCENT = 20


def with_split(df: DataFrame, row_key: str = "row_key", test_percent: int = TEST_PERCENT,
               folds: int = FOLDS) -> DataFrame:
    """Add ``split`` (train/test) and ``fold``; the two use different digits of the key."""
    key = F.col(row_key)
    return df.withColumns({
        "split": F.when(stable_bucket(key, 1, 100) < test_percent, "test").otherwise("train"),
        "fold": stable_bucket(key, 9, folds),
    })


def coded(df: DataFrame, row_key: str = "row_key") -> DataFrame:
    """Split, fold and a 64-bit code in the place of the key: what training needs of it, for tables that are written once and read often."""
    return with_split(df, row_key).withColumn(CODE, F.xxhash64(row_key)).drop(row_key)


def ensure_split(df: DataFrame, row_key: str = "row_key") -> DataFrame:
    return df if CODE in df.columns else with_split(df, row_key)
