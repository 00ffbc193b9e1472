"""Where intermediate tables lie, and how they are written and removed."""

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="bitnear-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or else the one given to setCheckpointDir.

    Where neither is set, a session with a local master gets a folder of its own, as in tests; on a cluster each executor
    would write to its own disk, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = _own_dir()
    return found.rstrip("/")


_MADE: list["Workspace"] = []


class Workspace:
    """A private folder under the shared one. A table written here survives the loss of any executor and cuts lineage.

    Results of operators read from it, so it stays until clear() is called.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.written: set[str] = set()
        _MADE.append(self)

    def write(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        """Write as Parquet, and give back the table that reads it (with the same schema, also where it has no rows)."""
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{self.path}/{name}")
        self.written.add(name)
        return self.read(name, df.schema)

    def read(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(f"{self.path}/{name}")

    def drop(self, name: str = "") -> None:
        """Remove a table that nothing reads any more, or the whole folder."""
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.written = self.written - {name} if name else set()

    def keep_only(self, *names: str) -> None:
        """Remove all tables written but these, which results that are not yet computed still read."""
        for name in self.written - set(names):
            self.drop(name)


def clear() -> None:
    """Remove the folders of all operators run in this process, once their results have been read or written elsewhere."""
    while _MADE:
        _MADE.pop().drop()


def slots(spark: SparkSession) -> int:
    """The number of partitions for work whose size is bound by CPU rather than bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def file_partitions(df: DataFrame) -> int:
    """The number of partitions of a table that is read and projected only; 0 if it is the result of a shuffle.

    Counting the latter's partitions would run its stages.
    """
    plan = df._jdf.queryExecution().sparkPlan()
    return 0 if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else plan.execute().getNumPartitions()


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are slots, for work bound by CPU; left alone if it has them already."""
    n = slots(df.sparkSession)
    return df if file_partitions(df) >= n else df.repartition(n)
