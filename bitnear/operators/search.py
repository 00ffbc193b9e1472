"""Batch search: an array of target hashes against one table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitnear.functions.bits import NO_COLUMN, NULL_DISTANCE
from bitnear.operators.join import similarity_join

# Texts of the errors that callers match on.
NULL_TARGET_ERROR = "target array cannot contain NULL values"
TOO_MANY_ERROR = "too many targets, maximum is "


def batch_search(
    df: DataFrame,
    column: str,
    targets: list[int] | DataFrame,
    distance: int | None,
    key: str | None = None,
    max_targets: int | None = None,
    strategy: str = "auto",
) -> DataFrame:
    """(target, match, key) for every target and every row of df whose hash is within the distance of it.

    targets is a list of integers, checked at once, or a table of one bigint column of any size, whose nulls match
    nothing. key names the column that identifies a row; without it all columns of df follow target and match.
    A target given twice gives its rows twice. No targets, no rows. Null hashes never match. There is no limit on the
    number of targets unless max_targets sets one.
    """
    if column not in df.columns:
        raise ValueError(NO_COLUMN.format(column))
    if key is not None and key not in df.columns:
        raise ValueError(NO_COLUMN.format(key))
    if distance is None:
        raise ValueError(NULL_DISTANCE)
    if isinstance(targets, DataFrame):
        wanted = targets.select(F.col(targets.columns[0]).cast("bigint").alias("target"))
    else:
        if any(t is None for t in targets):
            raise ValueError(NULL_TARGET_ERROR)
        if max_targets is not None and len(targets) > max_targets:
            raise ValueError(f"{TOO_MANY_ERROR}{max_targets}")
        wanted = df.sparkSession.createDataFrame([(int(t),) for t in targets], "target bigint")
    rest = [df[key].alias("key")] if key else [df[c].alias(f"row_{i}") for i, c in enumerate(df.columns)]
    found = similarity_join(df.select(df[column].alias("match"), *rest), wanted, "match", "target", distance, "inner", strategy)
    if key:
        return found.select("target", "match", "key")
    return found.select("target", "match", *[F.col(f"row_{i}").alias(c) for i, c in enumerate(df.columns)])
