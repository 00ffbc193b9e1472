import random

import pytest
from pyspark.sql import functions as F

from bitnear.llm.top_bands import band_shares, top_in_groups


def test_each_band_holds_twice_the_one_above():
    assert band_shares(0, 5) == band_shares(5, 5) == []
    assert band_shares(1000, 100) == [0.1, 0.3, 0.7]
    assert band_shares(250, 100) == [0.4]


@pytest.mark.parametrize("n", [1, 3, 1000])
def test_same_as_sorting(spark, rows, n):
    rng = random.Random(n)
    some = [(1, rng.randrange(40), rng.randrange(9)) for _ in range(600)]  # one group with a third of all rows and many ties
    some += [(rng.randrange(2, 200), rng.randrange(60), rng.randrange(3)) for _ in range(1000)] * 2
    some += [(None, 1, 1), (1, None, 1), (1, 1, None)]
    want = []
    for g in {r[0] for r in some if r[0]}:
        want += sorted({r for r in some if r[0] == g and None not in r}, key=lambda r: (r[1] // 2, r[1], r[2]))[:n]
    df = spark.createDataFrame(some, "g bigint, have bigint, n bigint")
    got = top_in_groups(df, "g", n, F.col("have") / 2, ["have", "n"])
    assert rows(got) == sorted(want, key=repr)
    assert top_in_groups(df.where("false"), "g", n, F.col("have") / 2, ["have", "n"]).count() == 0


def test_low_bands_fill_what_high_bands_leave(spark, rows):
    """Groups that only the last band can fill, and groups that cross a border."""
    some = [(g, b, 0) for g in range(50) for b in range(5)] + [(99, b, 0) for b in range(40, 60)] + [(98, 0, 0), (98, 45, 0), (98, 46, 0)]
    df = spark.createDataFrame(some, "g bigint, b bigint, c bigint")
    got = rows(top_in_groups(df, "g", 2, F.col("b"), ["b", "c"]))
    assert got == sorted([(g, b, 0) for g in range(50) for b in range(2)] + [(99, 40, 0), (99, 41, 0), (98, 0, 0), (98, 45, 0)], key=repr)


@pytest.mark.parametrize("kind", ["double", "decimal(20,3)", "bigint"])
def test_any_score(spark, rows, kind):
    """Thousands of values, negative ones and a few rows that hold most of the range, with groups of very unequal sizes."""
    rng = random.Random(5)
    some = [(1, i) for i in range(4000)] + [(rng.randrange(2, 300), 10_000 + i) for i in range(2000)]
    score = {i: rng.choice([rng.gauss(0, 1000), rng.uniform(-5, 5), 1e9]) // (1 if kind == "bigint" else 0.125) for _, i in some}
    df = spark.createDataFrame([(g, i, float(score[i])) for g, i in some], "g bigint, i bigint, s double").withColumn("s", F.col("s").cast(kind))
    want = []
    for g in {g for g, _ in some}:
        want += [(g, i) for i in sorted((i for x, i in some if x == g), key=lambda i: (score[i], i))[:3]]
    assert rows(top_in_groups(df, "g", 3, F.col("s"), ["i"]).select("g", "i")) == sorted(want, key=repr)


def test_nan_comes_last(spark, rows):
    df = spark.createDataFrame([(1, 1, float("nan")), (1, 2, 5.0), (2, 3, float("nan")), (2, 4, None)], "g bigint, i bigint, s double")
    assert rows(top_in_groups(df, "g", 1, F.col("s"), ["i"]).select("g", "i")) == [(1, 2), (2, 3)]
