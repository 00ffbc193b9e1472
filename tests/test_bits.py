import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bitnear import area, equal_bits, from_bitstring, hamming, register, register_search, to_bitstring, within, within_area

LEAST, MOST = -(2**63), 2**63 - 1
longs = st.one_of(st.integers(LEAST, MOST), st.sampled_from([0, 1, -1, LEAST, MOST]))
# Bit strings of integers.
STRINGS = {0: "0" * 64, 1: "0" * 63 + "1", 2: "0" * 62 + "10", -1: "1" * 64, -2: "1" * 63 + "0", MOST: "0" + "1" * 63}


def bits(a, b):
    return ((a ^ b) & (2**64 - 1)).bit_count()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(longs, longs, longs), min_size=1, max_size=40))
def test_distance_is_a_metric_and_counts_bits(spark, triples):
    df = spark.createDataFrame(triples, "a bigint, b bigint, c bigint")
    for (a, b, c), r in zip(triples, df.select(hamming("a", "b"), hamming("b", "a"), hamming("b", "c"), hamming("a", "c"), within("a", "b", "c")).collect(), strict=True):
        assert r[0] == r[1] == bits(a, b) and r[2] == bits(b, c) and r[3] == bits(a, c) <= r[0] + r[2]
        assert r[4] == (bits(a, b) <= c)


def test_types_and_nulls(spark):
    df = spark.createDataFrame([(1, None), (None, 1), (None, None)], "a bigint, b bigint")
    out = df.select(hamming("a", "b").alias("d"), equal_bits("a", "b").alias("e"), within("a", 0, "b").alias("w"), within_area(F.lit(0), area("a", "b")).alias("i"), to_bitstring("a").alias("s"))
    assert dict(out.dtypes)["d"] == "bigint"
    assert [tuple(r)[:4] for r in out.collect()] == [(None,) * 4] * 3


@pytest.mark.parametrize("distance, n", [(-1, 0), (LEAST, 0), (0, 1), (1, 2), (63, 2), (64, 3), (100, 3), (MOST, 3)])
def test_extreme_distances(spark, distance, n):
    df = spark.createDataFrame([(5,), (4,), (~5,), (None,)], "a bigint")
    assert df.where(within("a", 5, distance)).count() == n


def test_bit_strings(spark):
    df = spark.createDataFrame(list(STRINGS.items()), "v bigint, s string")
    assert df.where((to_bitstring("v") != F.col("s")) | (from_bitstring("s") != F.col("v"))).count() == 0


@pytest.mark.parametrize(
    "text, error",
    [
        ("wat", "bitstring_to_int64() input MUST be 64 characters long. Passed string length: 3"),
        ("", "bitstring_to_int64() input MUST be 64 characters long. Passed string length: 0"),
        ("é" * 32 + "0", "bitstring_to_int64() input MUST be 64 characters long. Passed string length: 65"),
        ("1" * 20 + "x" + "0" * 43, "bitstring_to_int64() input can only contain either '1' or '0'. Found bad char 'x' at index 20"),
    ],
)
def test_bad_bit_strings(spark, text, error):
    register(spark)
    df = spark.createDataFrame([(text,)], "s string")
    df.createOrReplaceTempView("bad")
    for out in (df.select(from_bitstring("s")), spark.sql("SELECT bitstring_to_int64(s) FROM bad")):
        with pytest.raises(Exception) as e:
            out.collect()
        assert error in str(e.value)


def test_sql_functions(spark, rows):
    register(spark)
    got = spark.sql(
        "SELECT hamming_distance(5, 6), hash_equal(1, 1), within_area(5, area(4, 1)), within_ball(5, 2, 2), within_area(5, area(NULL, 1)), "
        "bitstring_to_int64(int64_to_bitstring(-9)), hamming_distance(NULL, 1)"
    )
    assert rows(got) == [(2, True, True, False, None, -9, None)]
    spark.createDataFrame([(1, 100), (2, 101), (3, None)], "id bigint, h bigint").createOrReplaceTempView("own")
    register_search(spark, "own_search", "own", "h", "id")
    assert rows(spark.sql("SELECT * FROM own_search(array(100, 100), 1)")) == [(100, 100, 1), (100, 100, 1), (100, 101, 2), (100, 101, 2)]
    with pytest.raises(ValueError, match='column "x" does not exist'):
        register_search(spark, "own_search", "own", "x", "id")


def test_a_predicate_stays_in_generated_code(spark):
    from bitnear.plans.shape import physical_plan

    plan = physical_plan(spark.range(10).where(within("id", 3, 1)))
    assert "bit_count" in plan and "Python" not in plan
