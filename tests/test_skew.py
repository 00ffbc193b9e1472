import pytest
from pyspark.sql import functions as F

from bitnear import heavy_keys, per_key_join, skew_join
from bitnear.operators import skew


@pytest.fixture
def tables(spark):
    """A key with a third of all rows, one of middling weight, many rare ones, nulls and repeats."""
    left = [(9, i, "x") for i in range(400)] + [(8, i, "y") for i in range(60)] + [(i, i, None) for i in range(100, 800)] + [(None, 1, "z")] * 40
    right = [(9, 5, 1)] * 3 + [(8, 6, 2), (7, 7, 3), (None, 8, 4)] + [(i, i, 0) for i in range(100, 300)]
    return spark.createDataFrame(left, "key bigint, v bigint, s string"), spark.createDataFrame(right, "key bigint, v bigint, v_right bigint")


def test_heavy_keys(spark, tables):
    left, _ = tables
    assert {r[0] for r in heavy_keys(left, "key", 0.04).collect()} == {8, 9}
    assert heavy_keys(left.where("false"), "key").collect() == []
    assert heavy_keys(left.where("key is null"), "key").collect() == []
    assert {r[0] for r in heavy_keys(left, "s", 0.5).collect()} == {"x"}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("most", [1000, 2])
def test_skew_join_is_a_join(spark, tables, rows, monkeypatch, how, most):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", most)  # 2: the heavy part is salted
    left, right = tables
    got = skew_join(left, right, "key", how, 0.04)
    plain = right.select("key", F.col("v").alias("a"), F.col("v_right").alias("b"))
    assert rows(got) == rows(left.join(plain, "key", how))
    assert len(set(got.columns)) == len(got.columns)
    with pytest.raises(ValueError):
        skew_join(left, right, "key", "full")


def test_empty_sides(spark, tables):
    left, right = tables
    assert skew_join(left.where("false"), right, "key").count() == 0
    assert skew_join(left, right.where("false"), "key", "left").count() == left.count()


def test_per_key_results(spark, tables, rows):
    left, right = tables
    total, most = F.sum("v"), F.max("v")
    got = per_key_join(left, right, "key", ("total", total), ("most", most), 0.04)
    want = left.groupBy("key").agg(total.alias("total")).join(right.groupBy("key").agg(most.alias("most")), "key")
    assert rows(got) == rows(want)
    assert per_key_join(left.where("false"), right, "key", ("total", total), ("most", most)).count() == 0
    nulls = left.withColumn("v", F.lit(None).cast("bigint"))
    assert per_key_join(nulls, right, "key", ("total", total), ("most", most)).count() == 0
