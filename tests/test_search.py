import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from bitnear import append_pivot_layout, ball_filter, batch_search, choose_pivots, nearest, pivot_ball_filter, similarity_join, write_pivot_layout
from bitnear.operators.join import ball_counts
from bitnear.plans import selectivity
from bitnear.plans.shape import operators, physical_plan, search_report
from bitnear.sources.hashes import append, append_numbered, drop, exists, random_hashes, read_hash_lines, statistics, targets
from bitnear.streaming.search import stream_search


def bits(a, b):
    return ((a ^ b) & (2**64 - 1)).bit_count()


def skewed(rng):
    near = [rng.getrandbits(64) - 2**63 for _ in range(30)]
    near += [h ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for h in near]
    return near + list(range(40)) + [7] * 5 + [None] * 3


@pytest.mark.parametrize("distance", [-1, 0, 3, 7, 100])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti", "right", "full"])
def test_strategies_agree_with_brute_force(spark, rows, distance, how):
    rng = random.Random(distance)
    a, b = skewed(rng)[::2], [*skewed(random.Random(distance))[::5], 7, 7]
    left = spark.createDataFrame([(i, h) for i, h in enumerate(a)], "id bigint, h bigint")
    right = spark.createDataFrame([(h, i) for i, h in enumerate(b)], "t bigint, id bigint")
    pairs = [(i, h, t, j) for (i, h), (j, t) in itertools.product(enumerate(a), enumerate(b)) if h is not None and t is not None and bits(h, t) <= distance]
    met, met_right = {p[0] for p in pairs}, {p[3] for p in pairs}
    alone = [(None, None, t, j) for j, t in enumerate(b) if j not in met_right]
    want = {
        "inner": pairs,
        "left": pairs + [(i, h, None, None) for i, h in enumerate(a) if i not in met],
        "right": pairs + alone,
        "full": pairs + [(i, h, None, None) for i, h in enumerate(a) if i not in met] + alone,
        "left_semi": [(i, h) for i, h in enumerate(a) if i in met],
        "left_anti": [(i, h) for i, h in enumerate(a) if i not in met],
    }[how]
    for strategy in ("scan", "bands", "pivot", "auto"):
        got = similarity_join(left, right, "h", "t", distance, how, strategy)
        assert got.columns == (["id", "h"] if how in ("left_semi", "left_anti") else ["id", "h", "t", "id_right"])
        assert rows(got) == sorted(want, key=repr), strategy


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti", "right", "full"])
@pytest.mark.parametrize("distance", [1, "d"])
def test_scans_in_blocks_and_bands_by_row(spark, rows, monkeypatch, how, distance):
    left = spark.createDataFrame([(i, "x" * 50) for i in [*range(60), 3, 3, None, 1 << 40]], "a bigint, s string")
    right = spark.createDataFrame([(i, [0, 2, 5, 11, 30, 99, -1, None][i % 8]) for i in [*range(50), 3]] + [(None, 2), (-1, 3)], "b bigint, d bigint") if distance == "d" else spark.range(30).withColumnRenamed("id", "b")
    pairs = [(a["a"], a["s"], *b) for a in left.collect() for b in right.collect() if a["a"] is not None and b["b"] is not None and b[-1] is not None and bits(a["a"], b["b"]) <= (b["d"] if distance == "d" else 1)]
    got = similarity_join(left, right, "a", "b", distance, how, "scan")
    if how == "inner":
        assert rows(got) == sorted(pairs, key=repr)
    want = rows(got)
    assert rows(similarity_join(left, right, "a", "b", distance, how, "bands")) == want
    monkeypatch.setattr(selectivity, "BROADCAST_ROWS", 16)
    again = similarity_join(left, right, "a", "b", distance, how, "scan")
    assert rows(again) == want
    monkeypatch.setattr(selectivity, "BROADCAST_ROWS", 1000)
    monkeypatch.setattr(selectivity, "BROADCAST_BYTES", 500)
    assert rows(similarity_join(left, right, "a", "b", distance, how, "scan")) == want


def test_what_is_broadcast_is_measured(spark):
    wide = spark.range(100).selectExpr("id", "repeat('x', 1000) AS s", "array(id, id) AS l", "if(id > 50, 'y', null) AS t")
    assert selectivity.fits(wide, 100, 1 << 20) and not selectivity.fits(wide, 99, 1 << 20) and not selectivity.fits(wide, 100, 100_000)
    assert selectivity.fits(wide.where("false"))
    assert selectivity.few_rows(wide, 100) == 100 and selectivity.few_rows(wide, 99) is None


@pytest.mark.parametrize("how", ["right", "full", "left"])
def test_no_join_broadcasts_a_large_side_whole(spark, monkeypatch, how):
    monkeypatch.setattr(selectivity, "BROADCAST_ROWS", 100)
    left, right = random_hashes(spark, 5000), random_hashes(spark, 4000, 2).withColumnRenamed("hash", "other")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = physical_plan(similarity_join(left, right, "hash", "other", 3, how, "bands"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Broadcast" not in plan and "Cartesian" not in plan


def test_ball_counts_make_no_pairs_for_balls_that_hold_everything(spark, rows):
    rng = random.Random(5)
    hashes = [*skewed(rng), 1 << 62, -1]
    balls = [(h, d) for h in hashes[::9] for d in (-1, 0, 1, 2, 3, 4, 5, 6, 7, 8, 12, 13, 40, 63, 64, 2**63 - 1, None)] + [(7, 3)]
    balls = spark.createDataFrame(balls, "c bigint, d bigint")
    want = {}
    for c, d in {tuple(b) for b in balls.collect()}:
        if c is not None and d is not None and (n := sum(h is not None and bits(h, c) <= d for h in hashes)):
            want[c, min(d, 64)] = n
    table = spark.createDataFrame([(h,) for h in hashes], "h bigint")
    assert rows(ball_counts(table, "h", balls, "c", "d")) == sorted(((*k, n) for k, n in want.items()), key=repr)
    for few in ("d = 0", "d BETWEEN 6 AND 7", "d = 12", "d < 0"):
        own = {tuple(b) for b in balls.where(few).collect()}
        assert rows(ball_counts(table, "h", balls.where(few), "c", "d")) == sorted(((*k, n) for k, n in want.items() if k in own), key=repr)
    plan = physical_plan(ball_counts(table, "h", balls.where("d > 63"), "c", "d"))
    assert "Join" not in plan


@pytest.mark.parametrize("strategy, distance", [("bands", 8), ("bands", "d"), ("pivot", 8)])
def test_no_join_broadcasts_what_explode_made_large(spark, tmp_path, strategy, distance):
    """The table of balls is small, but not once its probes are made."""
    random_hashes(spark, 5000).write.parquet(f"{tmp_path}/rows")
    random_hashes(spark, 100, 2).selectExpr("hash AS other", "id % 9 AS d").write.parquet(f"{tmp_path}/balls")
    left, right = spark.read.parquet(f"{tmp_path}/rows"), spark.read.parquet(f"{tmp_path}/balls")
    joined = similarity_join(left, right, "hash", "other", distance, strategy=strategy)
    plan = joined._jdf.queryExecution().optimizedPlan()
    assert "strategy=merge" in plan.toString()
    assert not re.search(r"BroadcastExchange(?:(?!Exchange).)*Generate explode", physical_plan(joined), re.DOTALL)


@pytest.mark.parametrize("distance, blocks", [(0, 1), (3, 4), (4, 5), (7, 4), (8, 5), (12, 5), (16, 6), (30, None), (64, None), (-1, None)])
def test_blocks_for_a_distance(distance, blocks):
    assert selectivity.band_plan(distance) == blocks
    if blocks:
        assert len(selectivity.flip_masks(selectivity.bit_blocks(blocks)[0], 1)) in (1 + 64 // blocks, 2 + 64 // blocks)


def test_distance_of_each_row_and_conditions(spark, rows):
    left = spark.createDataFrame([(1, 100), (2, 101), (3, 200)], "id bigint, h bigint")
    balls = spark.createDataFrame([(100, 0), (100, 1), (200, None), (None, 3), (200, -1)], "c bigint, d bigint")
    assert rows(similarity_join(left, balls, "h", "c", "d").select("id", "c", "d")) == [(1, 100, 0), (1, 100, 1), (2, 100, 1)]
    got = similarity_join(left, balls, "h", "c", 1, condition=lambda l, r: (l("id") > 1) & (r("d") == 1))
    assert rows(got.select("id", "d")) == [(2, 1)]
    full = similarity_join(left, balls, "h", "c", 0, "full")
    assert full.count() == 3 + 1 + 2  # (1, both), 2, (3, both), and the ball without a centre


def test_refusals(spark):
    df = spark.range(3)
    for call, error in (
        (lambda: similarity_join(df, df, "id", "x", 1), 'column "x" does not exist'),
        (lambda: similarity_join(df, df, "id", "id", None), "distance cannot be NULL"),
        (lambda: similarity_join(df, df, "id", "id", 1, "cross"), "there is no cross join"),
        (lambda: similarity_join(df, df, "id", "id", 1, strategy="index"), "there is no strategy index"),
        (lambda: batch_search(df, "x", [1], 1), 'column "x" does not exist'),
        (lambda: batch_search(df, "id", [1, None], 1), "target array cannot contain NULL values"),
        (lambda: batch_search(df, "id", list(range(65)), 1, max_targets=64), "too many targets, maximum is 64"),
        (lambda: batch_search(df, "id", [1], None), "distance cannot be NULL"),
        (lambda: ball_filter(df, "id", 1, None), "distance cannot be NULL"),
        (lambda: ball_filter(df, "x", 1, 1), 'column "x" does not exist'),
    ):
        with pytest.raises(ValueError, match=error):
            call()


def test_batch_search(spark, rows):
    df = spark.createDataFrame([(i, h) for i, h in enumerate([100, 101, 102, 103, 200, 201, 202, 203, None])], "key bigint, target bigint")
    for d, n in ((0, 2), (1, 6), (3, 8)):
        assert batch_search(df, "target", [100, 200], d, "key").count() == n
    got = batch_search(df, "target", list(range(1, 11)), 2, "key").select("target", "match")
    assert rows(got) == sorted([(4, 100), (5, 101), (6, 102), (7, 103), (8, 200), (9, 201), (10, 202)], key=repr)
    assert batch_search(df, "target", [], 64).count() == 0
    assert batch_search(df, "target", list(range(100)), 64).count() == 800
    assert batch_search(df, "target", [100, 100], 0).columns == ["target", "match", "key", "target"]
    assert batch_search(df.where("false"), "target", [1], 64, "key").count() == 0
    assert batch_search(df, "target", spark.createDataFrame([(100,), (None,)], "x bigint"), 0, "key").count() == 1


# Rows of 0..511 within radii 1..4 of centres, and of 0..9 around 5.
@pytest.mark.parametrize(
    "n, center, counts",
    [(512, 0, (10, 46, 130, 256)), (512, 1023, (1, 10, 46, 130)), (512, 10, (10, 46, 130, 256)), (10, 5, (4, 8, 10, 10))],
)
def test_known_balls(spark, n, center, counts):
    df = spark.range(n).withColumnRenamed("id", "a")
    assert tuple(ball_filter(df, "a", center, d).count() for d in (1, 2, 3, 4)) == counts


def test_nearest(spark):
    df = spark.createDataFrame([(3, 7), (1, 7), (2, 6), (4, None), (5, 0)], "id bigint, h bigint")
    assert [(r["id"], r["hamming_distance"]) for r in nearest(df, "h", 7, 3, ["id"]).collect()] == [(1, 0), (3, 0), (2, 1)]
    plan = physical_plan(nearest(df, "h", 7, 3, ["id"]))
    assert "TakeOrderedAndProject" in plan
    assert nearest(df, "h", 7, 3, ["id"], 0).count() == 2


def test_equality_is_pushed_to_parquet(spark, tmp_path):
    spark.range(100).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    assert "EqualTo(id,7)" in physical_plan(ball_filter(df, "id", 7, 0))


def test_join_shapes(spark):
    left, right = random_hashes(spark, 1000), targets(spark, [1, 2, 3]).select("target")
    plan = physical_plan(similarity_join(left, right, "hash", "target", 3, strategy="scan"))
    assert "BroadcastNestedLoopJoin" in plan and "Python" not in plan
    assert "NestedLoop" not in physical_plan(similarity_join(left, right, "hash", "target", 3, strategy="bands"))
    assert any("Join" in o for o in operators(similarity_join(left, right, "hash", "target", 3)))


def test_strategy_choice(spark, monkeypatch):
    even = random_hashes(spark, 2000)
    dense = spark.range(2000).withColumnRenamed("id", "hash")
    assert selectivity.choose(even, even.limit(10), "hash", "hash", 3) == "scan"
    assert selectivity.choose(even, even, "hash", "hash", 3) == selectivity.choose(even, even, "hash", "hash", 8) == "bands"
    assert selectivity.choose(dense, dense, "hash", "hash", 3) == "scan"
    assert selectivity.choose(even, even, "hash", "hash", 40) == selectivity.choose(even, even, "hash", "hash", -1) == "scan"


def test_search_report(spark):
    rows = random_hashes(spark, 100)
    found = batch_search(rows, "hash", [1, 2], 64, "id")
    assert tuple(search_report(found, [1, 2], 64).first()) == ("scan", 2, 64, 200)
    for strategy in ("bands", "pivot"):
        wanted = rows.select("hash")
        assert tuple(search_report(batch_search(rows, "hash", wanted, 2, "id", strategy=strategy), wanted, 2).first()) == (strategy, 100, 2, 100)


def test_selectivity():
    assert [selectivity.model_selectivity(d) for d in (-1, 0, 15, 64)] == [0.0, 1e-9, 0.5, 0.5]
    assert selectivity.model_selectivity(None) == selectivity.model_selectivity(4)
    assert selectivity.uniform_share(64) == 1.0 and selectivity.uniform_share(-1) == 0.0 and selectivity.uniform_share(0) == 2.0**-64


def test_pivot_layout(spark, rows, tmp_path):
    df = random_hashes(spark, 300).unionAll(spark.createDataFrame([(1000 + i, i) for i in range(60)] + [(2000, None)], "id bigint, hash bigint"))
    more = spark.createDataFrame([(3000 + i, 9 ^ (1 << i)) for i in range(40)] + [(4000, None)], "id bigint, hash bigint")
    path = f"{tmp_path}/p"
    write_pivot_layout(df, "hash", path)
    append_pivot_layout(more, path)
    for d in (-1, 0, 2, 5, 30, 64, 2**63 - 1):
        got = pivot_ball_filter(spark, path, 9, d)
        assert rows(got.select("id", "hash")) == rows(ball_filter(df.unionAll(more), "hash", 9, d))
    plan = physical_plan(pivot_ball_filter(spark, path, 9, 2))
    assert "PartitionFilters: [isnotnull(pivot_distance_0" in plan and "GreaterThanOrEqual(pivot_distance_1" in plan
    assert choose_pivots(df.where("false"), "hash") == [] and len(choose_pivots(df, "hash", 3)) == 3
    with pytest.raises(ValueError, match="own columns"):
        write_pivot_layout(df.withColumn("pivot_distance_0", F.lit(1)), "hash", path)
    write_pivot_layout(df.where("false"), "hash", path)
    assert pivot_ball_filter(spark, path, 9, 64).count() == 0


def test_pivots_read_few_rows(spark):
    """In clustered data the pivot chosen is one that lets a ball skip most rows."""
    near = [(b << 58) + (1 << i) for b in range(8) for i in range(40)] + [(0x5555555555555555 >> 1) ^ (1 << i) for i in range(50)]
    pivot = choose_pivots(spark.createDataFrame([(h,) for h in near], "h bigint"), "h", 1)[0]
    read = sum(abs(bits(h, pivot) - bits(near[-1], pivot)) <= 4 for h in near)
    assert read < len(near) / 2


def test_sources(spark, rows, tmp_path):
    (tmp_path / "x.data").write_text("5\n-7\n9223372036854775807")
    assert rows(read_hash_lines(spark, f"{tmp_path}/x.data")) == [(-7,), (5,), (9223372036854775807,)]
    (tmp_path / "bad.data").write_text("5\nfive\n")
    with pytest.raises(Exception, match="MALFORMED|five"):
        read_hash_lines(spark, f"{tmp_path}/bad.data").collect()
    assert rows(targets(spark, [4, None, 4])) == [(1, 4), (2, None), (3, 4)] and targets(spark, []).count() == 0
    for _ in range(2):
        append(spark.range(3), f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 6
    assert rows(random_hashes(spark, 5)) == rows(random_hashes(spark, 5))


def test_stream(spark, rows, tmp_path):
    spark.createDataFrame([(1, 100, 5), (2, None, 5), (3, 7, 5)], "id bigint, h bigint, target int").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id bigint, h bigint, target int").parquet(f"{tmp_path}/in")
    found = stream_search(stream, "h", targets(spark, [101, None]).select("target"), 1)
    run = found.writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    run.awaitTermination()
    assert rows(spark.table("found")) == [(1, 100, 101)]
    blocks = stream_search(stream, "h", targets(spark, [101, None, *range(10)]).select("target"), 1, most=3)
    run = blocks.writeStream.format("memory").queryName("blocks").trigger(availableNow=True).start()
    run.awaitTermination()
    assert rows(spark.table("blocks")) == sorted([(1, 100, 101), *[(3, 7, t) for t in (3, 5, 6, 7)]], key=repr)


def test_integer_range_predicates(spark):
    df = spark.range(10).withColumnRenamed("id", "a")
    a = F.col("a")
    assert [df.where(x).count() for x in (a < 7, a > 7, a <= 7, a >= 7, a == 7)] == [7, 2, 8, 3, 1]


def test_serial_keys_go_on(spark, rows, tmp_path):
    path = f"{tmp_path}/serial"
    append_numbered(spark.createDataFrame([(5, "x"), (None, "y"), (3, "z"), (5, "x")], "a bigint, id string"), path, ["a"])
    append_numbered(spark.createDataFrame([(1,), (0,)], "a bigint"), path, ["a"])
    append_numbered(spark.createDataFrame([], "a bigint"), path, ["a"])
    assert rows(spark.read.parquet(path)) == [(1, None), (2, 3), (3, 5), (4, 5), (5, 0), (6, 1)]
    assert exists(spark, path) and drop(spark, path) and not exists(spark, path) and not drop(spark, path)


def test_statistics(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,), (None,), (None,)], "h bigint")
    assert tuple(statistics(df, "h").first()) == (6, 3, 2, 2)
    assert tuple(statistics(df.where("false"), "h").first()) == (0, 0, 0, 0)
