"""Metric partitioning as a file layout that lasts: rows lie by their distances to pivots, which are kept beside them.

By the triangle inequality a ball of radius r around q holds only rows whose distance to a pivot p is within r of
hamming(p, q). The distance to the first pivot is the folder, so other folders are not listed; inside a folder rows are sorted
by the distances to the further pivots, which are columns, so Parquet's statistics skip row groups. Uniform hashes crowd
around distance 32, so the layout pays for clustered data.
"""

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from bitnear.functions.bits import NO_COLUMN, hamming
from bitnear.operators.ball import ball_filter

#: Rows on which pivots are judged, and candidates judged. Only the layout depends on them, no result.
PIVOT_SAMPLE, PIVOT_CANDIDATES = 4096, 64
#: The radius of the balls that pivots are chosen for.
PIVOT_RADIUS = 4


def choose_pivots(df: DataFrame, column: str, levels: int = 2, seed: int = 7) -> list[int]:
    """Pivots, each the one with which balls around rows of a bounded sample read the fewest rows of it. Fewer without hashes."""
    hashes = df.where(F.col(column).isNotNull()).select(F.col(column).alias("h")).distinct()
    sample = np.array([r["h"] for r in hashes.orderBy(F.xxhash64("h", F.lit(seed)), "h").limit(PIVOT_SAMPLE).collect()], np.int64)
    queries, chosen = sample[: PIVOT_CANDIDATES * 4], []
    reached = np.ones((len(queries), len(sample)), bool)
    for _ in range(levels if len(sample) else 0):
        costs = []
        for pivot in sample[:PIVOT_CANDIDATES]:
            away = np.bitwise_count((sample ^ pivot).view(np.uint64)).astype(np.int64)
            own = np.bitwise_count((queries ^ pivot).view(np.uint64)).astype(np.int64)
            costs.append(int((reached & (np.abs(own[:, None] - away) <= PIVOT_RADIUS)).sum()))
        best = sample[int(np.argmin(costs))]
        away, own = (np.bitwise_count((x ^ best).view(np.uint64)).astype(np.int64) for x in (sample, queries))
        reached &= np.abs(own[:, None] - away) <= PIVOT_RADIUS
        chosen.append(int(best))
    return chosen


def _names(n: int) -> list[str]:
    return [f"pivot_distance_{i}" for i in range(n)]


def write_pivot_layout(df: DataFrame, column: str, path: str, pivots: list[int] | None = None) -> None:
    """Write df, and the pivots, which are chosen unless given. Null hashes go to the default folder.

    Columns pivot_distance_0, 1, ... are the layout's own. An older layout in the folder is replaced.
    """
    pivots = pivots or choose_pivots(df, column) or [0]
    _write(df, column, path, pivots, "overwrite")
    about = [(i, p, column, df.schema.json()) for i, p in enumerate(pivots)]
    kept = df.sparkSession.createDataFrame(about, "level int, pivot bigint, column string, schema string")
    kept.coalesce(1).write.mode("overwrite").parquet(f"{path}/pivots")


def append_pivot_layout(df: DataFrame, path: str) -> None:
    """Add rows with the same columns to a layout, by its own pivots."""
    column, pivots, schema = _kept(df.sparkSession, path)
    _write(df.select(*schema.names), column, path, pivots, "append")


def _write(df: DataFrame, column: str, path: str, pivots: list[int], mode: str) -> None:
    names = _names(len(pivots))
    if column not in df.columns:
        raise ValueError(NO_COLUMN.format(column))
    if set(names) & set(df.columns):
        raise ValueError(f"{', '.join(names)} are the layout's own columns")
    placed = df.withColumns({n: hamming(F.col(column), p).cast("int") for n, p in zip(names, pivots, strict=True)})
    # small folders share a task and a crowded one is split, so there are few files and no overloaded task
    placed.hint("rebalance", names[0]).sortWithinPartitions(*names).write.mode(mode).partitionBy(names[0]).parquet(f"{path}/rows")


def _kept(spark: SparkSession, path: str) -> tuple[str, list[int], StructType]:
    rows = spark.read.schema("level int, pivot bigint, column string, schema string").parquet(f"{path}/pivots").orderBy("level").collect()  # a row a level
    return rows[0]["column"], [r["pivot"] for r in rows], StructType.fromJson(json.loads(rows[0]["schema"]))


def pivot_ball_filter(spark: SparkSession, path: str, center: int, distance: int) -> DataFrame:
    """ball_filter over a pivot layout; the ranges of distances become partition and row group filters."""
    column, pivots, schema = _kept(spark, path)
    d = max(-1, min(distance, 64))
    for name in _names(len(pivots)):
        schema = schema.add(name, IntegerType())
    table = spark.read.schema(schema).parquet(f"{path}/rows")
    for name, pivot in zip(_names(len(pivots)), pivots, strict=True):
        away = ((center ^ pivot) & (2**64 - 1)).bit_count()
        table = table.where(F.col(name).between(away - d, away + d))
    return ball_filter(table, column, center, distance).drop(*_names(len(pivots)))
