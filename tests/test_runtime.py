import os

import pytest
from pyspark.sql import functions as F

from bitnear import runtime
from bitnear.runtime import Workspace, clear, file_partitions, shared_dir, slots, spread


def test_tables_lie_in_the_shared_folder_until_cleared(spark, rows):
    work = Workspace(spark, "own")
    table = work.write(spark.range(5), "t")
    assert work.path.startswith(shared_dir(spark)) and rows(table) == [(i,) for i in range(5)]
    assert work.write(spark.range(0), "none").columns == ["id"]
    parts = work.write(spark.range(4).selectExpr("id", "id % 2 AS p"), "parts", ["p"])
    assert rows(parts.where("p = 1")) == [(1, 1), (3, 1)]
    at = work.path.removeprefix("file://")
    work.drop("t")
    assert not os.path.exists(f"{at}/t") and os.path.exists(f"{at}/parts")
    work.write(spark.range(1), "u")
    work.keep_only("u")
    assert os.path.exists(f"{at}/u") and not os.path.exists(f"{at}/parts") and work.written == {"u"}
    clear()
    assert not os.path.exists(at) and not runtime._MADE


class Session:
    """A session with a master and folders as a cluster's, or a laptop's, may have them."""

    def __init__(self, folder, other, master):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = self
        self.getCheckpointDir, self.master = (lambda: other), master


def test_the_set_folder_is_used():
    assert shared_dir(Session("file:///a/", "file:///b", "spark://x:7077")) == "file:///a"
    assert shared_dir(Session(None, "file:///b", "yarn")) == "file:///b"
    assert shared_dir(Session(None, None, "local[4]")).startswith("file:///")


@pytest.mark.parametrize("master", ["yarn", "spark://x:7077", "local-cluster[3,2,1024]"])
def test_no_folder_of_one_machine_on_a_cluster(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session(None, None, master))


def test_spread(spark, tmp_path):
    n = slots(spark)
    assert spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == n
    assert spread(spark.range(10, numPartitions=n + 3)).rdd.getNumPartitions() == n + 3
    assert file_partitions(spark.range(10, numPartitions=3)) == 3 and file_partitions(spark.range(10).groupBy(F.col("id") % 3).count()) == 0
