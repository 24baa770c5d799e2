"""Correlations of wide tables: the product matrix is tiled by blocks of columns.

Sums of products of k columns need k-by-k matrices. Beyond ``WIDTH`` columns no task holds them whole: columns are cut into blocks
of ``WIDTH``, and every pair of blocks is a scan of its own that reads these columns only, so a task holds six WIDTH-by-WIDTH
matrices per group, whatever k is. Scans of all tiles run side by side. A tile's scan is narrowed to at most ``STATES`` tasks, so a tile
sends at most ``STATES`` partial sums per pair and group (more only where groups do not fit in a task's memory together), which
Spark adds up.

Defined cases: a pair counts the rows where both sides are present; NaN counts as missing. Rows without cohort are left out. Pairs
that share no row have n 0 and no correlation. Repeated column names, and columns named like a group, are an error; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortwise.bounded import materialize
from cohortwise.functions.columns import nan_to_null
from cohortwise.operators.stats import centers_and_scales, correlation_from_sums, profile

#: Columns of a block.
WIDTH = 512
#: Tasks of a tile's scan.
STATES = 64
#: Bytes of sums that a task holds before it hands them on, and rows that are multiplied at once.
HELD_BYTES, CHUNK = 1 << 28, 2048
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")
#: Pairs in one emitted batch.
EMITTED = 1 << 16


def _distinct(by: Sequence[str], columns: Sequence[str]) -> list[str]:
    if len({*by, *columns}) < len(by) + len(columns):
        raise ValueError("columns must have names of their own")
    return list(columns)


def blocks(columns: Sequence[str], width: int = WIDTH) -> list[range]:
    """Positions of the columns of each block."""
    return [range(at, min(at + width, len(columns))) for at in range(0, len(columns), width)]


def block_profile(df: DataFrame, columns: Sequence[str], by: Sequence[str], width: int = WIDTH) -> DataFrame:
    """``profile`` of any number of columns, NaN as missing: one aggregation per block of columns."""
    plain = lambda block: df.select(*by, *[nan_to_null(F.col(columns[i]).cast("double")).alias(columns[i]) for i in block])
    return reduce(DataFrame.unionByName, [profile(plain(b), [columns[i] for i in b], by) for b in blocks(columns, width)])


def rectangle(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The six sums of every pair of a column of ``x`` with one of ``y``, over the rows where both are present."""
    here, there = ~np.isnan(x), ~np.isnan(y)
    if here.all() and there.all():
        shape = (x.shape[1], y.shape[1])
        wide = lambda v: np.broadcast_to(v, shape)
        return np.stack([np.full(shape, float(len(x))), wide(x.sum(0)[:, None]), wide(y.sum(0)), wide((x * x).sum(0)[:, None]), wide((y * y).sum(0)), x.T @ y])
    x, y, p, q = np.where(here, x, 0.0), np.where(there, y, 0.0), here.astype("float64"), there.astype("float64")
    return np.stack([p.T @ q, x.T @ q, p.T @ y, (x * x).T @ q, p.T @ (y * y), x.T @ y])


def _tile(df: DataFrame, columns: Sequence[str], by: list[str], left: range, right: range,
          affine: dict[str, dict[str, tuple[float, float]]], schema: T.StructType, states: int) -> DataFrame:
    """Partial sums of the pairs i < j of two blocks (i <= j within the columns' order)."""
    both = list(left) if left == right else [*left, *right]
    names = [columns[i] for i in both]
    scales = {c: (np.array([f[n][0] for n in names]), np.array([f[n][1] for n in names])) for c, f in affine.items()}
    first = slice(0, len(left))
    second = first if left == right else slice(len(left), None)
    i, j = np.meshgrid(np.array(left), np.array(right), indexing="ij")
    wanted = i < j
    at = i[wanted].astype("int32"), j[wanted].astype("int32")
    most = max(1, HELD_BYTES // (48 * len(left) * len(right)))
    kinds = {name: pa.int32() if name in "ij" else pa.float64() for name in schema.names[len(by):]}

    def emitted(held: dict, groups: pa.Schema) -> Iterator[pa.RecordBatch]:
        for key, sums in held.items():
            values = [s[wanted] for s in sums]
            for start in range(0, len(at[0]), EMITTED):
                cut = slice(start, start + EMITTED)
                n = len(at[0][cut])
                arrays = [pa.repeat(pa.scalar(v, groups.field(g).type), n) for g, v in enumerate(key)]
                arrays += [pa.array(v[cut], kinds[name]) for name, v in zip(("i", "j", *SUMS), (*at, *values))]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        groups = None
        for batch in batches:
            groups = batch.schema
            keys = batch.select(list(range(len(by)))).to_pandas()
            for key, rows in keys.groupby(list(keys.columns), dropna=False, sort=False).indices.items():
                key = tuple(None if v != v else v for v in (key if isinstance(key, tuple) else (key,)))
                shift, scale = scales[key[0]]
                for start in range(0, len(rows), CHUNK):
                    part = batch.take(pa.array(rows[start:start + CHUNK]))
                    z = np.stack([part.column(len(by) + c).to_numpy(zero_copy_only=False) for c in range(len(names))], axis=1)
                    sums = rectangle(((z - shift) / scale)[:, first], ((z - shift) / scale)[:, second])
                    held[key] = held[key] + sums if key in held else sums
            if len(held) > most:
                yield from emitted(held, groups)
                held = {}
        if held:
            yield from emitted(held, groups)

    # A value stays in a column of its own name only by position: block columns may be called like anything.
    rows = df.select(*by, *[F.col(columns[p]).cast("double").alias(f"v{k}") for k, p in enumerate(both)])
    return rows.coalesce(states).mapInArrow(fold, schema)


def tiled_pair_sums(df: DataFrame, columns: Sequence[str], by: Sequence[str], shifts: dict[str, dict[str, tuple[float, float]]],
                    width: int = WIDTH, states: int = STATES) -> DataFrame:
    """(by..., i, j, n, sx, sy, sxx, syy, sxy) for all i < j by the columns' order, in shifted and scaled units.

    ``by[0]`` is the cohort. ``df`` is read once per pair of blocks: hand in a table that is cheap to scan.
    """
    by, columns = list(by), _distinct(by, columns)
    schema = T.StructType([T.StructField(b, df.schema[b].dataType) for b in by] + [T.StructField(c, T.IntegerType()) for c in "ij"]
                          + [T.StructField(s, T.DoubleType()) for s in SUMS])
    cut = blocks(columns, width)
    rows = df.where(F.col(by[0]).isNotNull())
    tiles = [_tile(rows, columns, by, left, right, shifts, schema, states) for k, left in enumerate(cut) for right in cut[k:]]
    # A pair stands in one tile, so tiles are added up one by one.
    added = [t.groupBy(*by, "i", "j").agg(*[F.sum(s).alias(s) for s in SUMS]) for t in tiles]
    return reduce(DataFrame.unionAll, added)


def tiled_correlation_pairs(df: DataFrame, columns: Sequence[str], cohort: str, stats: DataFrame | None = None,
                            width: int = WIDTH, states: int = STATES) -> DataFrame:
    """(cohort, a, b, n, corr) as ``stats.correlation_pairs`` gives it, for any number of columns.

    The columns asked for are written once, so that each tile's scan reads its own columns of a columnar table.
    """
    columns = _distinct([cohort], columns)
    narrow = materialize(df.where(F.col(cohort).isNotNull()).select(cohort, *[nan_to_null(F.col(c).cast("double")).alias(c) for c in columns]), "wide")
    found = block_profile(narrow, columns, [cohort], width) if stats is None else stats
    sums = tiled_pair_sums(narrow, columns, [cohort], centers_and_scales(found, cohort), width, states)
    spark = df.sparkSession
    named = spark.createDataFrame(pa.table({"place": pa.array(range(len(columns)), pa.int32()), "name": pa.array(columns, pa.string())}))
    side = lambda at, name: F.broadcast(named.select(F.col("place").alias(at), F.col("name").alias(name)))
    return sums.join(side("i", "a"), "i").join(side("j", "b"), "j").select(
        cohort, "a", "b", F.col("n").cast("bigint").alias("n"), correlation_from_sums().alias("corr"))
