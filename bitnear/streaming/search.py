"""Batch search over a stream of rows: stateless, as the targets are a static table."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitnear.functions.bits import within
from bitnear.plans.selectivity import BROADCAST_ROWS, few_rows


def stream_search(stream: DataFrame, column: str, targets: DataFrame, distance: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of the stream with each target (first column of targets) within the distance, in append mode.

    The targets are broadcast once per micro-batch, `most` at a time (8 bytes each); more go in blocks, each of which
    reads the micro-batch again. A column target of the stream is replaced. Null hashes and null targets match nothing.
    """
    wanted = targets.select(F.col(targets.columns[0]).cast("bigint").alias("target")).where(F.col("target").isNotNull())
    blocks = 1 if few_rows(wanted, most) is not None else -(-wanted.count() // most) * 2  # half full on average
    block = F.pmod(F.xxhash64("target"), F.lit(blocks))
    rows = stream.drop("target")
    found = [rows.join(F.broadcast(wanted.where(block == i) if blocks > 1 else wanted), within(F.col(column), F.col("target"), distance)) for i in range(blocks)]
    return reduce(DataFrame.unionAll, found)
