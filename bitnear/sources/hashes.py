"""Sources and sinks for hash tables. Schemas are declared, never inferred."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitnear.runtime import Workspace, slots


def read_hash_lines(spark: SparkSession, path: str, column: str = "a") -> DataFrame:
    """Text files with one signed integer per line and no header; anything else fails the query."""
    return spark.read.schema(f"`{column}` bigint").option("mode", "FAILFAST").csv(path)


def random_hashes(spark: SparkSession, rows: int, seed: int = 1) -> DataFrame:
    """(id, hash) with ids from 1 and reproducible, evenly spread hashes: the first 64 bits of the MD5 of "id:seed"."""
    ids = spark.range(1, rows + 1)
    return ids.select("id", _leading_bits(F.md5(F.concat_ws(":", "id", F.lit(seed)))).alias("hash"))


def targets(spark: SparkSession, values: list[int | None]) -> DataFrame:
    """(ordinal, target) of a list, the ordinal from 1; empty lists and nulls are fine."""
    array = F.lit(values).cast("array<bigint>") if values else F.array().cast("array<bigint>")
    return spark.range(1).select(F.posexplode(array).alias("ordinal", "target")).withColumn("ordinal", F.col("ordinal") + 1)


def append(df: DataFrame, path: str) -> None:
    """Add rows to a Parquet table."""
    df.write.mode("append").parquet(path)


def append_numbered(df: DataFrame, path: str, order: list[str], key: str = "id") -> None:
    """Add rows to a Parquet table with a serial key that goes on from the largest one there, from 1 in a new table.

    Rows are numbered in the order given, nulls first, by ranges: each task numbers its own rows after those of the tasks
    before it, whose counts are one number a task. A column named as the key is replaced; rows equal in the order may be
    numbered either way.
    """
    spark = df.sparkSession
    work = Workspace(spark, "numbered")
    by = [F.col(c).asc_nulls_first() for c in order]
    placed = work.write(df.drop(key).repartitionByRange(slots(spark), *by).withColumn("__part", F.spark_partition_id()), "placed")
    last = spark.read.parquet(path).agg(F.max(key)).first()[0] if exists(spark, path) else 0
    before, at = [], last or 0
    for r in placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).orderBy("__part").collect():
        before.append((r["__part"], at))
        at += r["n"]
    offsets = F.broadcast(spark.createDataFrame(before, "__part int, __before bigint"))
    number = F.row_number().over(Window.partitionBy("__part").orderBy(*by)) + F.col("__before")
    placed.join(offsets, "__part").select(number.alias(key), *[c for c in df.columns if c != key]).write.mode("append").parquet(path)
    work.drop()


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def drop(spark: SparkSession, path: str) -> bool:
    """Remove a table; False if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def statistics(df: DataFrame, column: str) -> DataFrame:
    """(rows, nulls, hashes, heaviest): counts of all rows, of nulls, of different hashes, and of the rows of the commonest one."""
    each = df.groupBy(F.col(column).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    there = F.col("h").isNotNull()
    return each.agg(
        zero(F.sum("n")).alias("rows"), zero(F.sum(F.when(~there, F.col("n")))).alias("nulls"), F.count("h").alias("hashes"), zero(F.max(F.when(there, F.col("n")))).alias("heaviest")
    )


def embedding_hash(column: str) -> Column:
    """64 signs of an array of 64 floats as a hash, first element in the highest bit; null for other lengths."""
    bits = F.array_join(F.transform(F.col(column), lambda x: F.when(x > 0, F.lit("1")).otherwise(F.lit("0"))), "")
    return F.when(F.length(bits) == 64, F.conv(bits, 2, -10).cast("bigint"))


def _leading_bits(md5: Column) -> Column:
    return F.conv(F.substring(md5, 1, 16), 16, -10).cast("bigint")


def content_hash(column: str) -> Column:
    """The first 64 bits of the MD5 of a text."""
    return _leading_bits(F.md5(F.col(column)))
