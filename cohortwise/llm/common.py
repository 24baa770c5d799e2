"""Reading, scratch tables and small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable
from functools import reduce
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.bounded import scratch_dir

#: The white space of all text contracts.
WHITE = " \t\n\x0b\x0c\r"
#: Narrow rows that one task writes where their number is known.
FILE_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(column: str = "text") -> Column:
    """The text, empty where it is NULL."""
    return F.coalesce(F.col(column), F.lit(""))


def without(text: Column, characters: str = WHITE) -> Column:
    """Delete single characters with plain byte searches (no regular expression)."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), characters, text)


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def scanned(rows: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column, Column]], kind: str) -> Column:
    """Array (of DDL type ``kind``) gathered from left to right: ``step(state, row)`` gives the next state, whether to keep, and a value.

    Rows are taken in blocks of about the square root of their number, so that appending copies little. NULL rows give NULL.
    """
    def inner(acc: Column, row: Column) -> Column:
        state, keep, value = step(acc["state"], row)
        return F.struct(state.alias("state"), F.when(keep, F.concat(acc["out"], F.array(value))).otherwise(acc["out"]).alias("out"))

    def outer(acc: Column, block: Column) -> Column:
        done = F.aggregate(block, F.struct(acc["state"].alias("state"), F.array().cast(kind).alias("out")), inner)
        return let(done, lambda d: F.struct(d["state"].alias("state"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

    def blocks(all_rows: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(all_rows))).cast("int")
        cut = F.transform(F.sequence(F.lit(0), F.size(all_rows) - 1, width), lambda at: F.slice(all_rows, at + 1, width))
        return F.when(F.size(all_rows) > 0, cut).otherwise(F.when(all_rows.isNotNull(), F.array(all_rows)))

    zero = F.struct(start.alias("state"), F.array().cast(f"array<{kind}>").alias("out"))
    return let(rows, lambda r: F.aggregate(blocks(r), zero, outer, lambda acc: F.flatten(acc["out"])))


def matches(text: Column, pattern: Column, group: int = 0) -> Column:
    """Array of (gap before, length, length of a group) of all matches."""
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    found = F.struct(hits.alias("hits"), F.split(text, pattern, -1).alias("pieces"),
                     (F.regexp_extract_all(text, pattern, F.lit(group)) if group else hits).alias("values"))

    def rows(f: Column) -> Column:
        gaps = F.transform(F.slice(f["pieces"], F.lit(1), F.size(f["hits"])), F.length)
        sizes = F.zip_with(gaps, f["hits"], lambda gap, hit: F.struct(gap.alias("gap"), F.length(hit).alias("n")))
        return F.zip_with(sizes, f["values"], lambda a, v: F.struct(a["gap"].alias("gap"), a["n"].alias("n"), F.length(v).alias("v")))

    return let(found, rows)


def scratch_path(spark: SparkSession, tag: str) -> str:
    return os.path.join(scratch_dir(spark), f"{tag}-{uuid.uuid4().hex}")


def written(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there.

    A table of up to ``rows`` narrow rows is written by as many tasks as these fill, not by one per shuffle partition.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, tag)
    (df if rows is None else df.coalesce(partitions_for(rows, FILE_ROWS))).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def drop_written(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete scratch tables that nothing reads any more."""
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def mounted_folder(spark: SparkSession, tag: str) -> str:
    """A new folder below the shared one as a path that ``open`` and ``mmap`` take on every machine."""
    parsed = urlparse(scratch_path(spark, tag))
    if parsed.scheme not in ("", "file"):
        raise ValueError("memory-mapped models need spark.checkpoint.dir on a mounted shared file system")
    os.makedirs(parsed.path, exist_ok=True)
    return parsed.path


def partitions_for(rows: int, per_partition: int) -> int:
    """As many partitions as the rows need, and at least the session's default."""
    return max(8, -(-rows // per_partition))
