"""The core's queries over the test tables, each with SQL that gives the same rows."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitnear.functions.bits import area, equal_bits, from_bitstring, hamming, to_bitstring, within, within_area
from bitnear.functions.sql import register, register_search
from bitnear.operators.ball import ball_filter, nearest
from bitnear.operators.join import ball_counts, similarity_join
from bitnear.operators.pivot import append_pivot_layout, pivot_ball_filter, write_pivot_layout
from bitnear.operators.search import batch_search
from bitnear.operators.skew import per_key_join, skew_join
from bitnear.plans.selectivity import model_selectivity
from bitnear.plans.shape import search_report
from bitnear.runtime import Workspace
from bitnear.sources.hashes import append, append_numbered, content_hash, embedding_hash, random_hashes, read_hash_lines, statistics, targets
from bitnear.streaming.search import stream_search

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: A centre in the midst of the small integers, and one among the spread hashes.
CENTER = 100
#: 70 targets: more than one 64-bit mask could hold. Every third is one of the small integers of the table.
TARGETS = [3 * i for i in range(70)]


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, at: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{at}/{name}.parquet")


def stored(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "test_batch_join").select("id", "hash")


@query(
    "SELECT hash, first_id, low_tid FROM (SELECT hash, arg_min(id, (seen_at, id)) AS first_id FROM test_batch_join "
    "WHERE hash IS NOT NULL AND seen_at IS NOT NULL GROUP BY hash) JOIN (SELECT target_hash AS hash, min(match_tid) AS low_tid "
    "FROM bktree_batch_search WHERE match_tid IS NOT NULL GROUP BY target_hash) USING (hash)"
)
def p4_found(spark: SparkSession, at: str) -> DataFrame:
    seen = table(spark, at, "test_batch_join").select("hash", "id", "seen_at").where(F.col("seen_at").isNotNull())
    pairs = table(spark, at, "bktree_batch_search").select(F.col("target_hash").alias("hash"), "match_tid")
    earliest = F.min(F.struct("seen_at", "id"))["id"]
    return per_key_join(seen, pairs, "hash", ("first_id", earliest), ("low_tid", F.min("match_tid")))


@query(
    "SELECT hash, count(*) AS pairs, min(id) AS least_id, max(match_hash) AS most_match FROM test_batch_join "
    "JOIN (SELECT target_hash AS hash, min(match_hash) AS match_hash FROM bktree_batch_search GROUP BY 1) USING (hash) GROUP BY hash"
)
def p4_rows_with_targets(spark: SparkSession, at: str) -> DataFrame:
    pairs = table(spark, at, "bktree_batch_search").groupBy(F.col("target_hash").alias("hash")).agg(F.min("match_hash").alias("match_hash"))
    joined = skew_join(stored(spark, at), pairs, "hash")
    return joined.groupBy("hash").agg(F.count(F.lit(1)).alias("pairs"), F.min("id").alias("least_id"), F.max("match_hash").alias("most_match"))


_D = "CAST(bit_count(xor({0}, {1})) AS BIGINT)"
_IN = "bit_count(xor({0}, {1})) <= {2}"
_VALUES = "(VALUES " + ", ".join(f"({t}::BIGINT)" for t in TARGETS) + ") AS t(target)"


@query(f"SELECT target_hash, match_hash, match_tid, run_no, {_D.format('target_hash', 'match_hash')} AS distance FROM bktree_batch_search")
def hamming_distance(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "bktree_batch_search").withColumn("distance", hamming("target_hash", "match_hash"))


@query(f"SELECT area_id, center = {CENTER} AS equal, {_IN.format(CENTER, 'center', 'distance')} AS inside FROM bktree_area")
def ball_predicate(spark: SparkSession, at: str) -> DataFrame:
    rows = table(spark, at, "bktree_area").withColumn("ball", area("center", "distance"))
    return rows.select("area_id", equal_bits("center", CENTER).alias("equal"), within_area(CENTER, "ball").alias("inside"))


@query(f"SELECT id, hash FROM test_batch_join WHERE {_IN.format('hash', CENTER, 3)}")
def ball_filter_rows(spark: SparkSession, at: str) -> DataFrame:
    return ball_filter(stored(spark, at), "hash", CENTER, 3)


@query(
    f"SELECT a, {_D.format('a', CENTER)} AS distance, {_IN.format('a', CENTER, 2)} AS inside, a::BIT::VARCHAR AS bits "
    f"FROM int8tmp_2 WHERE {_IN.format('a', CENTER, 4)}"
)
def ball_projection(spark: SparkSession, at: str) -> DataFrame:
    rows = ball_filter(table(spark, at, "int8tmp_2"), "a", CENTER, 4)
    return rows.select("a", hamming("a", CENTER).alias("distance"), within("a", CENTER, 2).alias("inside"), to_bitstring("a").alias("bits"))


@query("SELECT id, hash, batch_no FROM test_batch_join WHERE hash = 7")
def eq_lookup(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "test_batch_join").select("id", "hash", "batch_no").where(equal_bits("hash", 7))


@query(
    "SELECT count(*) FILTER (WHERE a < v) AS lt, count(*) FILTER (WHERE a <= v) AS le, count(*) FILTER (WHERE a = v) AS eq, "
    "count(*) FILTER (WHERE a >= v) AS ge, count(*) FILTER (WHERE a > v) AS gt FROM int8tmp_2, (SELECT 464571291354841 AS v)"
)
def range_predicates(spark: SparkSession, at: str) -> DataFrame:
    a, v = F.col("a"), 464571291354841
    tests = {"lt": a < v, "le": a <= v, "eq": a == v, "ge": a >= v, "gt": a > v}
    return table(spark, at, "int8tmp_2").agg(*[F.count_if(t).alias(n) for n, t in tests.items()])


@query(
    f"SELECT r AS radius, count(*) FILTER (WHERE {_IN.format('hash', CENTER, 'r')}) AS n FROM test_batch_join, "
    "(SELECT unnest(range(0, 65)) AS r) GROUP BY r"
)
def ball_count_by_radius(spark: SparkSession, at: str) -> DataFrame:
    """One scan for all 65 radii: the rows are counted by distance, and the counts joined."""
    counts = stored(spark, at).groupBy(hamming("hash", CENTER).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    radii = spark.range(65).withColumnRenamed("id", "radius")
    return radii.join(F.broadcast(counts), F.col("d") <= F.col("radius"), "left").groupBy("radius").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


@query(f"SELECT id, hash FROM test_batch_join WHERE {_IN.format('hash', CENTER, 4)} AND {_IN.format('hash', 2, 4)}")
def two_ball_and(spark: SparkSession, at: str) -> DataFrame:
    return ball_filter(ball_filter(stored(spark, at), "hash", CENTER, 4), "hash", 2, 4)


@query(f"SELECT id, hash, {_D.format('hash', CENTER)} AS hamming_distance FROM test_batch_join WHERE hash IS NOT NULL ORDER BY 3, 1 LIMIT 25")
def order_by_distance_topk(spark: SparkSession, at: str) -> DataFrame:
    return nearest(stored(spark, at), "hash", CENTER, 25, ["id"])


def _batch(spark: SparkSession, at: str, values: list[int], distance: int) -> DataFrame:
    wanted = targets(spark, values).select("target")
    return similarity_join(stored(spark, at), wanted, "hash", "target", distance)


@query(f"SELECT id, hash, target FROM test_batch_join JOIN (VALUES (100::BIGINT), (200)) AS t(target) ON {_IN.format('hash', 'target', 3)}")
def batch_join(spark: SparkSession, at: str) -> DataFrame:
    return _batch(spark, at, [100, 200], 3)


@query(f"SELECT id, hash, target FROM test_batch_join JOIN (VALUES (100::BIGINT), (100), (200)) AS t(target) ON {_IN.format('hash', 'target', 2)}")
def batch_join_duplicate_targets(spark: SparkSession, at: str) -> DataFrame:
    return _batch(spark, at, [100, 100, 200], 2)


@query(
    "SELECT id, hash, batch_no, target FROM test_batch_join JOIN (VALUES (100::BIGINT), (200)) AS t(target) "
    f"ON {_IN.format('hash', 'target', 3)} AND batch_no > 0 AND id > target"
)
def batch_join_extra_predicate(spark: SparkSession, at: str) -> DataFrame:
    rows = table(spark, at, "test_batch_join").select("id", "hash", "batch_no")
    wanted = targets(spark, [100, 200]).select("target")
    return similarity_join(rows, wanted, "hash", "target", 3, condition=lambda l, r: (l("batch_no") > 0) & (l("id") > r("target")))


@query(
    "SELECT area_id, coalesce(sum(n), 0)::BIGINT AS matches FROM bktree_area LEFT JOIN (SELECT hash, count(*) AS n FROM test_batch_join "
    f"WHERE hash IS NOT NULL GROUP BY hash) ON {_IN.format('hash', 'center', 'distance')} GROUP BY area_id"
)
def batch_join_per_row_distance(spark: SparkSession, at: str) -> DataFrame:
    """All balls, wide and empty ones too; equal hashes are compared once, and equal balls searched once."""
    balls = table(spark, at, "bktree_area")
    found = ball_counts(stored(spark, at), "hash", balls, "center", "distance").withColumnRenamed("distance", "most")
    balls = balls.withColumn("most", F.least("distance", F.lit(64)))
    return balls.join(found, ["center", "most"], "left").select("area_id", F.coalesce("matches", F.lit(0)).alias("matches"))


@query(
    "SELECT ordinal, target, id FROM test_batch_join JOIN (VALUES (1::INTEGER, 200::BIGINT), (2, 100), (3, 7)) AS t(ordinal, target) "
    f"ON {_IN.format('hash', 'target', 1)}"
)
def batch_join_ordinality(spark: SparkSession, at: str) -> DataFrame:
    return similarity_join(stored(spark, at), targets(spark, [200, 100, 7]), "hash", "target", 1).select("ordinal", "target", "id")


@query(f"SELECT id, hash, target FROM test_batch_join JOIN {_VALUES} ON {_IN.format('hash', 'target', 2)}")
def batch_join_over_64(spark: SparkSession, at: str) -> DataFrame:
    return _batch(spark, at, TARGETS, 2)


@query(f"SELECT count(*) AS count FROM (SELECT s.*, target FROM test_batch_join s JOIN {_VALUES} ON {_IN.format('hash', 'target', 10)}) AS x")
def batch_join_count(spark: SparkSession, at: str) -> DataFrame:
    return _batch(spark, at, TARGETS, 10).agg(F.count(F.lit(1)).alias("count"))


@query(
    "SELECT q.hash AS target, t.hash AS match, t.id AS key FROM test_batch_join t JOIN "
    f"(SELECT DISTINCT hash FROM test_batch_join WHERE id % 20 = 0) q ON {_IN.format('t.hash', 'q.hash', 3)}"
)
def batch_search_rows(spark: SparkSession, at: str) -> DataFrame:
    """The search of every twentieth row's hash in all rows."""
    rows = stored(spark, at)
    return batch_search(rows, "hash", rows.where(F.col("id") % 20 == 0).select("hash").distinct(), 3, key="id", strategy="bands")


@query("SELECT t.hash AS target, t.hash AS match, t.id AS key FROM test_batch_join t WHERE false")
def empty_targets(spark: SparkSession, at: str) -> DataFrame:
    return batch_search(stored(spark, at), "hash", [], 3, key="id")


_KNOWN = "(SELECT DISTINCT a FROM int8tmp_2)"


@query(f"SELECT a, count(id) AS matches, min(id) AS first_id FROM {_KNOWN} LEFT JOIN test_batch_join ON {_IN.format('a', 'hash', 2)} GROUP BY a")
def left_join(spark: SparkSession, at: str) -> DataFrame:
    known = table(spark, at, "int8tmp_2").distinct()
    joined = similarity_join(known, stored(spark, at), "a", "hash", 2, "left", "bands")
    return joined.groupBy("a").agg(F.count("id").alias("matches"), F.min("id").alias("first_id"))


@query(f"SELECT id, hash FROM test_batch_join WHERE EXISTS (SELECT 1 FROM {_KNOWN} WHERE {_IN.format('a', 'hash', 3)})")
def semi_join(spark: SparkSession, at: str) -> DataFrame:
    return similarity_join(stored(spark, at), table(spark, at, "int8tmp_2"), "hash", "a", 3, "left_semi")


@query(f"SELECT id, hash FROM test_batch_join WHERE NOT EXISTS (SELECT 1 FROM {_KNOWN} WHERE {_IN.format('a', 'hash', 3)})")
def anti_join(spark: SparkSession, at: str) -> DataFrame:
    return similarity_join(stored(spark, at), table(spark, at, "int8tmp_2"), "hash", "a", 3, "left_anti")


@query(f"SELECT a, area_id FROM {_KNOWN} FULL JOIN bktree_area ON {_IN.format('a', 'center', 1)}")
def full_join(spark: SparkSession, at: str) -> DataFrame:
    known = table(spark, at, "int8tmp_2").distinct()
    return similarity_join(known, table(spark, at, "bktree_area"), "a", "center", 1, "full").select("a", "area_id")


@query(f"SELECT a, area_id FROM (SELECT * FROM {_KNOWN} WHERE a % 2 = 0) RIGHT JOIN bktree_area ON {_IN.format('a', 'center', 'distance')}")
def right_join(spark: SparkSession, at: str) -> DataFrame:
    """Each ball with the even hashes accepted before that lie in it, or with none."""
    known = table(spark, at, "int8tmp_2").distinct().where("a % 2 = 0")
    return similarity_join(known, table(spark, at, "bktree_area"), "a", "center", "distance", "right", "bands").select("a", "area_id")


@query(f"SELECT a, area_id FROM {_KNOWN} FULL JOIN bktree_area ON {_IN.format('a', 'center', 'distance')} AND area_id > 10")
def full_join_per_row_distance(spark: SparkSession, at: str) -> DataFrame:
    known = table(spark, at, "int8tmp_2").distinct()
    joined = similarity_join(known, table(spark, at, "bktree_area"), "a", "center", "distance", "full", condition=lambda l, r: r("area_id") > 10)
    return joined.select("a", "area_id")


@query("SELECT b.area_id, k.a, b.distance FROM bktree_area b LEFT JOIN (SELECT DISTINCT a FROM int8tmp_2) k ON b.center = k.a")
def left_equality_join(spark: SparkSession, at: str) -> DataFrame:
    balls = table(spark, at, "bktree_area")
    return similarity_join(balls, table(spark, at, "int8tmp_2").distinct(), "center", "a", 0, "left").select("area_id", "a", "distance")


@query(f"SELECT area_id, count(*) AS matches FROM bktree_area JOIN (SELECT DISTINCT hash FROM test_batch_join) ON {_IN.format('hash', 'center', 8)} GROUP BY area_id")
def wide_banded_join(spark: SparkSession, at: str) -> DataFrame:
    """Distance 8: hashes meet in blocks with up to two bits of the block flipped."""
    hashes = stored(spark, at).select("hash").distinct()
    found = similarity_join(hashes, table(spark, at, "bktree_area"), "hash", "center", 8, strategy="bands")
    return found.groupBy("area_id").agg(F.count(F.lit(1)).alias("matches"))


@query(f"SELECT a, count(*) AS matches FROM {_KNOWN} JOIN bktree_area ON {_IN.format('a', 'center', 5)} GROUP BY a")
def pivot_join(spark: SparkSession, at: str) -> DataFrame:
    known = table(spark, at, "int8tmp_2").distinct()
    found = similarity_join(known, table(spark, at, "bktree_area"), "a", "center", 5, strategy="pivot")
    return found.groupBy("a").agg(F.count(F.lit(1)).alias("matches"))


@query(f"SELECT area_id, count(*) AS matches FROM bktree_area JOIN (SELECT DISTINCT hash FROM test_batch_join) ON {_IN.format('hash', 'center', 4)} GROUP BY area_id")
def banded_join(spark: SparkSession, at: str) -> DataFrame:
    hashes = stored(spark, at).select("hash").distinct()
    found = similarity_join(hashes, table(spark, at, "bktree_area"), "hash", "center", 4, strategy="bands")
    return found.groupBy("area_id").agg(F.count(F.lit(1)).alias("matches"))


@query(f"SELECT id, hash FROM test_batch_join WHERE {_IN.format('hash', CENTER, 4)}")
def pivot_scan(spark: SparkSession, at: str) -> DataFrame:
    """Batch 0 is laid out, the later rows are added to the layout, and a ball is read from it."""
    rows, work = table(spark, at, "test_batch_join").select("id", "hash", "batch_no"), Workspace(spark, "pivot")
    write_pivot_layout(rows.where("batch_no = 0"), "hash", work.path)
    append_pivot_layout(rows.where("batch_no IS NULL OR batch_no <> 0"), work.path)
    return pivot_ball_filter(spark, work.path, CENTER, 4).select("id", "hash")


@query("SELECT id, hash::BIT::VARCHAR AS bits, hash AS back FROM test_batch_join")
def bitstring_round_trip(spark: SparkSession, at: str) -> DataFrame:
    bits = stored(spark, at).select("id", to_bitstring("hash").alias("bits"))
    return bits.withColumn("back", from_bitstring("bits"))


@query(
    f"SELECT id, {_D.format('hash', 10)} AS distance, {_IN.format('hash', 10, 4)} AS inside, hash = 10 AS equal, "
    "hash::BIT::VARCHAR AS bits, hash AS back FROM test_batch_join"
)
def sql_functions(spark: SparkSession, at: str) -> DataFrame:
    register(spark)
    stored(spark, at).createOrReplaceTempView("bitnear_stored")
    return spark.sql(
        "SELECT id, hamming_distance(hash, 10) AS distance, within_area(hash, area(10, 4)) AS inside, hash_equal(hash, 10) AS equal, "
        "int64_to_bitstring(hash) AS bits, bitstring_to_int64(int64_to_bitstring(hash)) AS back FROM bitnear_stored"
    )


@query(f"SELECT target, hash AS match, id AS key FROM test_batch_join JOIN (VALUES (10::BIGINT), (2)) AS t(target) ON {_IN.format('hash', 'target', 2)}")
def sql_table_function(spark: SparkSession, at: str) -> DataFrame:
    stored(spark, at).createOrReplaceTempView("bitnear_stored")
    register_search(spark, "bitnear_find", "bitnear_stored", "hash", "id")
    return spark.sql("SELECT * FROM bitnear_find(array(10, 2), 2)")


@query(
    "SELECT d AS distance, CASE WHEN d < 0 THEN 0.0 ELSE greatest(1e-10::DOUBLE, least(0.5::DOUBLE, 1e-9::DOUBLE * pow(4.0::DOUBLE, d))) END AS estimate "
    "FROM (SELECT unnest(range(-1, 65)) AS d)"
)
def selectivity_model(spark: SparkSession, at: str) -> DataFrame:
    return spark.createDataFrame([(d, model_selectivity(d)) for d in range(-1, 65)], "distance bigint, estimate double")


@query(
    "SELECT target, hash AS match, id AS key FROM (SELECT id, hash FROM test_batch_join UNION ALL FROM (VALUES (-1::BIGINT, 100::BIGINT), "
    f"(-2, 101), (-3, 102), (-4, 103))) JOIN (VALUES (100::BIGINT)) AS t(target) ON {_IN.format('hash', 'target', 3)}"
)
def appended_rows(spark: SparkSession, at: str) -> DataFrame:
    path = Workspace(spark, "appended").path
    append(stored(spark, at), path)
    append(spark.createDataFrame([(-1, 100), (-2, 101), (-3, 102), (-4, 103)], "id bigint, hash bigint"), path)
    return batch_search(spark.read.parquet(path), "hash", [100], 3, key="id")


_RANDOM = "(SELECT id, ('0x' || substr(md5(id || ':1'), 1, 16))::UBIGINT::BIT::BIGINT AS hash FROM (SELECT unnest(range(1, 10001)) AS id))"


@query(f"SELECT q.hash AS target, t.hash AS match, t.id AS key FROM {_RANDOM} t JOIN {_RANDOM} q ON q.id % 20 = 0 AND {_IN.format('t.hash', 'q.hash', 3)}")
def random_batch_join(spark: SparkSession, at: str) -> DataFrame:
    """Reproducible random hashes, searched around themselves: each finds at least itself."""
    rows = random_hashes(spark, 10_000)
    return batch_search(rows, "hash", rows.where("id % 20 = 0").select("hash"), 3, key="id", strategy="bands")


@query(f"SELECT id, hash, target FROM test_batch_join JOIN (VALUES (100::BIGINT), (200)) AS t(target) ON {_IN.format('hash', 'target', 3)}")
def streamed_search(spark: SparkSession, at: str) -> DataFrame:
    """The batch join over a stream of the table's rows, read to its end."""
    work, rows = Workspace(spark, "stream"), stored(spark, at)
    # a pattern, as a plain path would have to be a folder
    stream = spark.readStream.schema(rows.schema).parquet(f"{at}/test_batch_join.parque[t]")
    found = stream_search(stream, "hash", targets(spark, [100, 200]).select("target"), 3)
    run = found.writeStream.format("parquet").option("checkpointLocation", f"{work.path}/state").trigger(availableNow=True).start(f"{work.path}/rows")
    run.awaitTermination()
    return work.read("rows", found.schema)


_SIGNS = "list_aggregate(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), 'string_agg', '')::BIT::BIGINT"


@query(
    f"SELECT a.vec_id, count(b.vec_id) AS links FROM (SELECT vec_id, {_SIGNS} AS h FROM embeddings) a LEFT JOIN "
    f"(SELECT vec_id, {_SIGNS} AS h FROM embeddings) b ON {_IN.format('a.h', 'b.h', 20)} AND a.vec_id <> b.vec_id GROUP BY a.vec_id"
)
def embedding_near_pairs(spark: SparkSession, at: str) -> DataFrame:
    signs = table(spark, at, "embeddings").select("vec_id", embedding_hash("embedding").alias("h"))
    other = signs.select(F.col("vec_id").alias("other"), F.col("h").alias("other_h"))
    near = similarity_join(signs, other, "h", "other_h", 20, "left", "scan", lambda l, r: l("vec_id") != r("other"))
    return near.groupBy("vec_id").agg(F.count("other").alias("links"))


@query(
    "SELECT doc_id, min(doc_id) OVER same AS class_id, count(*) OVER same - 1 AS links FROM "
    "(SELECT doc_id, ('0x' || substr(md5(text), 1, 16))::UBIGINT::BIT::BIGINT AS h FROM documents) WINDOW same AS (PARTITION BY h)"
)
def document_exact_copies(spark: SparkSession, at: str) -> DataFrame:
    """One row per document with its class of equal texts; classes are formed by aggregation, so no class is gathered."""
    hashed = table(spark, at, "documents").select("doc_id", content_hash("text").alias("h"))
    classes = hashed.groupBy("h").agg(F.min("doc_id").alias("class_id"), (F.count(F.lit(1)) - 1).alias("links"))
    return skew_join(hashed, classes, "h").select("doc_id", "class_id", "links")


@query("SELECT trim(lower(origin)) AS origin, count(*) AS rows, count(DISTINCT hash) AS hashes FROM test_batch_join GROUP BY 1")
def rows_by_origin(spark: SparkSession, at: str) -> DataFrame:
    origin = F.trim(F.lower("origin")).alias("origin")
    return table(spark, at, "test_batch_join").groupBy(origin).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("hash").alias("hashes"))


@query("SELECT a FROM int8tmp_2 WHERE a IS NOT NULL")
def hash_lines(spark: SparkSession, at: str) -> DataFrame:
    """Hashes written one a line and read back."""
    path = f"{Workspace(spark, 'lines').path}/lines"
    table(spark, at, "int8tmp_2").where(F.col("a").isNotNull()).select(F.col("a").cast("string")).write.text(path)
    return read_hash_lines(spark, path)


@query("SELECT bit_count(xor(5::BIGINT, 6::BIGINT))::BIGINT AS distance, (-9)::BIGINT::BIT::VARCHAR AS bits, 1 = 1 AS equal, true AS inside")
def scalar_functions(spark: SparkSession, at: str) -> DataFrame:
    """Functions over constants, without a table."""
    register(spark)
    return spark.sql("SELECT hamming_distance(5, 6) AS distance, int64_to_bitstring(-9) AS bits, hash_equal(1, 1) AS equal, within_area(5, area(4, 1)) AS inside")


@query("SELECT a, a::BIT::VARCHAR = repeat('0', 57) || '1100100' AS same FROM int8tmp_2")
def bitstring_equality(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "int8tmp_2").select("a", (to_bitstring("a") == "0" * 57 + "1100100").alias("same"))


@query(f"SELECT 'scan' AS strategy, 2::BIGINT AS targets, 3::BIGINT AS distance, count(*) AS results FROM test_batch_join JOIN (VALUES (100::BIGINT), (200)) AS t(target) ON {_IN.format('hash', 'target', 3)}")
def search_plan_report(spark: SparkSession, at: str) -> DataFrame:
    wanted = [100, 200]
    return search_report(batch_search(stored(spark, at), "hash", wanted, 3, key="id"), wanted, 3)


@query(
    "SELECT row_number() OVER (ORDER BY batch, a NULLS FIRST) AS id, a FROM (SELECT a, 0 AS batch FROM int8tmp_2 UNION ALL SELECT center, 1 FROM bktree_area)"
)
def numbered_rows(spark: SparkSession, at: str) -> DataFrame:
    """A table with a serial key that is filled twice."""
    path = f"{Workspace(spark, 'serial').path}/rows"
    for rows in (table(spark, at, "int8tmp_2"), table(spark, at, "bktree_area").select(F.col("center").alias("a"))):
        append_numbered(rows, path, ["a"])
    return spark.read.schema("id bigint, a bigint").parquet(path)


@query(
    "SELECT count(*) AS rows, count(*) - count(hash) AS nulls, count(DISTINCT hash) AS hashes, (SELECT max(n) FROM (SELECT count(*) AS n FROM test_batch_join "
    "WHERE hash IS NOT NULL GROUP BY hash)) AS heaviest FROM test_batch_join"
)
def hash_statistics(spark: SparkSession, at: str) -> DataFrame:
    return statistics(table(spark, at, "test_batch_join"), "hash")
