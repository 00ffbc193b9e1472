"""Ball filters and nearest rows around one centre."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitnear.functions.bits import NO_COLUMN, NULL_DISTANCE, hamming, within


def ball_filter(df: DataFrame, column: str, center: Column | int, distance: Column | int | None) -> DataFrame:
    """Rows whose hash lies in the ball, all columns kept.

    A distance of 0 becomes an equality, which Parquet statistics can prune. Null hashes are dropped; an empty table
    gives no rows; repeated rows stay repeated. distance=None raises.
    """
    if distance is None:
        raise ValueError(NULL_DISTANCE)
    if column not in df.columns:
        raise ValueError(NO_COLUMN.format(column))
    if isinstance(distance, int) and distance == 0:
        return df.where(df[column] == center)
    return df.where(within(df[column], center, distance))


def nearest(df: DataFrame, column: str, center: int, k: int, tie_break: list[str], distance: int = 64) -> DataFrame:
    """The k rows nearest to the centre, nearest first, with their distance in hamming_distance.

    Ties are broken by the columns named, ascending, so the order is total. Spark plans it as TakeOrderedAndProject:
    each task keeps k rows. A column hamming_distance of the input is replaced.
    """
    found = ball_filter(df, column, center, distance).withColumn("hamming_distance", hamming(df[column], center))
    return found.orderBy("hamming_distance", *tie_break).limit(k)
