"""Queries of the operators for training data, with SQL where it can express them over whole tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitnear.functions.bits import hamming
from bitnear.llm.components import consolidate_matches
from bitnear.llm.fm_index import leaked_spans, removal_spans
from bitnear.llm.incremental import repeated_rows
from bitnear.llm.mixing import Mix, mix_sources
from bitnear.llm.rp_forest import nearest_by_area
from bitnear.llm.shared_spans import shared_share, shared_spans
from bitnear.llm.top_bands import top_in_groups

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, at: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{at}/{name}.parquet")


@query(
    "SELECT area_id, id FROM (SELECT a.area_id, t.id, row_number() OVER (PARTITION BY a.area_id "
    "ORDER BY bit_count(xor(t.hash, a.center)), t.id) AS place FROM bktree_area a JOIN test_batch_join t "
    "ON bit_count(xor(t.hash, a.center)) <= a.distance WHERE a.distance BETWEEN 0 AND 8) WHERE place <= 5"
)
def p1_found(spark: SparkSession, at: str) -> DataFrame:
    balls = table(spark, at, "bktree_area").select("area_id", "center", "distance").where(F.col("distance").between(0, 8))
    near = nearest_by_area(balls, "area_id", "center", "distance", table(spark, at, "test_batch_join"), "hash", "id", 5)
    return near.select(F.col("key").alias("area_id"), "id")


_BIG = "100000000000000000000"  # beyond any hash, so that records are vertices of their own


@query(
    f"WITH RECURSIVE r AS (SELECT target_hash::HUGEINT AS x, match_hash::HUGEINT AS y, match_tid::HUGEINT + {_BIG} AS z FROM bktree_batch_search), "
    "e AS (SELECT DISTINCT unnest([x, y, x, z, y, z]) AS a, unnest([y, x, z, x, z, y]) AS b FROM r), "
    "g(v, low) USING KEY (v) AS (SELECT DISTINCT unnest([x, y, z]) AS v, v FROM r UNION "
    "(SELECT old.v, min(g.low) FROM g JOIN e ON e.a = g.v JOIN recurring.g AS old ON old.v = e.b WHERE g.low < old.low GROUP BY old.v)) "
    f"SELECT (v - {_BIG})::BIGINT AS match_tid, CASE WHEN low < {_BIG} / 2 THEN low::BIGINT END AS group_hash FROM g WHERE v > {_BIG} / 2"
)
def p2_found(spark: SparkSession, at: str) -> DataFrame:
    pairs = table(spark, at, "bktree_batch_search")
    groups = consolidate_matches(pairs, ("target_hash", "match_hash"), "match_tid")
    return groups.select(F.col("record").alias("match_tid"), "group_hash")


@query(
    "SELECT target_hash, match_hash, match_tid FROM (SELECT *, row_number() OVER (PARTITION BY target_hash "
    "ORDER BY bit_count(xor(target_hash, match_hash)), match_hash, match_tid) AS place FROM (SELECT DISTINCT target_hash, match_hash, "
    "match_tid FROM bktree_batch_search WHERE target_hash IS NOT NULL AND match_hash IS NOT NULL AND match_tid IS NOT NULL)) WHERE place <= 3"
)
def p3_found(spark: SparkSession, at: str) -> DataFrame:
    rows = table(spark, at, "bktree_batch_search").select("target_hash", "match_hash", "match_tid")
    return top_in_groups(rows, "target_hash", 3, hamming("target_hash", "match_hash"), ["match_hash", "match_tid"])


@query(
    "SELECT source, doc_id, n_chars, rating FROM (SELECT trim(lower(source)) AS source, doc_id, n_chars, rating, row_number() OVER (PARTITION BY trim(lower(source)) "
    "ORDER BY -n_chars / greatest(rating, 1), doc_id) AS place FROM documents WHERE source IS NOT NULL AND rating IS NOT NULL) WHERE place <= 10"
)
def p3_best_reviews(spark: SparkSession, at: str) -> DataFrame:
    """The ten best reviews of each source by a score with thousands of values: length over rating."""
    rows = table(spark, at, "documents").select(F.trim(F.lower("source")).alias("source"), "doc_id", "n_chars", "rating")
    return top_in_groups(rows, "source", 10, -F.col("n_chars") / F.greatest("rating", F.lit(1)), ["doc_id"])


@query(
    # s: 0 undecided, 1 accepted, 2 a case; hashes accepted before have place 0 and those of the table follow in order
    "WITH RECURSIVE k AS (SELECT DISTINCT a AS h, 0 AS place FROM int8tmp_2 WHERE a IS NOT NULL), "
    "f AS (SELECT hash AS h, min((batch_no, id)) AS place, arg_min(id, (batch_no, id)) AS id FROM test_batch_join WHERE hash IS NOT NULL GROUP BY hash), "
    "n AS (SELECT h, 0 AS place, NULL::BIGINT AS id FROM k UNION ALL SELECT h, row_number() OVER (ORDER BY place), id FROM f WHERE h NOT IN (SELECT h FROM k)), "
    "p AS (SELECT x.h AS later, y.h AS earlier FROM n x JOIN n y ON y.place < x.place AND bit_count(xor(x.h, y.h)) <= 3), "
    "s(h, s) USING KEY (h) AS (SELECT h, CASE WHEN h IN (SELECT later FROM p) THEN 0 ELSE 1 END FROM n UNION "
    "(SELECT p.later, CASE WHEN bool_or(e.s = 1) THEN 2 ELSE 1 END FROM p JOIN recurring.s AS l ON l.h = p.later JOIN recurring.s AS e ON e.h = p.earlier "
    "WHERE l.s = 0 GROUP BY p.later HAVING bool_or(e.s = 1) OR bool_and(e.s = 2))) "
    "SELECT id FROM test_batch_join WHERE hash IS NOT NULL AND id NOT IN (SELECT n.id FROM n JOIN s USING (h) WHERE s.s = 1 AND n.id IS NOT NULL)"
)
def p5_found(spark: SparkSession, at: str) -> DataFrame:
    known = table(spark, at, "int8tmp_2").select("a")
    rows = table(spark, at, "test_batch_join")
    return repeated_rows(rows, "hash", "batch_no", "id", known).select(F.col("key").alias("id"))


def _leaks(spark: SparkSession, at: str) -> DataFrame:
    return leaked_spans(table(spark, at, "documents"), "doc_id", "text", table(spark, at, "eval_items"), "item_id", "text", 12)


_RUNS = (
    "SELECT {key}, unnest(range(0, len(w) - 11)) AS i, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i+11], ' '))) AS run "
    "FROM (SELECT {key}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table}) WHERE len(w) >= 12"
)


@query(f"SELECT DISTINCT doc_id, item_id FROM ({_RUNS.format(key='doc_id', table='documents')}) JOIN ({_RUNS.format(key='item_id', table='eval_items')}) USING (run)")
def p6_found(spark: SparkSession, at: str) -> DataFrame:
    return _leaks(spark, at).select("doc_id", "item_id").distinct()


@query(
    f"SELECT doc_id, min(i) AS first, max(i) + 12 AS last, count(DISTINCT item_id) AS items FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i, item_id) AS span "
    f"FROM (SELECT doc_id, item_id, d.i, coalesce((d.i > lag(d.i) OVER (PARTITION BY doc_id ORDER BY d.i, item_id) + 12)::INTEGER, 1) AS new "
    f"FROM ({_RUNS.format(key='doc_id', table='documents')}) d JOIN (SELECT DISTINCT item_id, run FROM ({_RUNS.format(key='item_id', table='eval_items')})) USING (run))) GROUP BY doc_id, span"
)
def p6_removal_spans(spark: SparkSession, at: str) -> DataFrame:
    return removal_spans(_leaks(spark, at))


def _mix(spark: SparkSession, at: str) -> Mix:
    documents = table(spark, at, "documents").select("doc_id", "source", "text")
    return mix_sources(documents, "doc_id", "source", "text", None, table(spark, at, "mix_targets"))


@query()
def p7_mix(spark: SparkSession, at: str) -> DataFrame:
    return _mix(spark, at).rows.withColumnRenamed("key", "doc_id")


@query()
def p7_shares(spark: SparkSession, at: str) -> DataFrame:
    return _mix(spark, at).shares


def _count_words(documents: DataFrame, text: str) -> DataFrame:
    return documents.withColumn("tokens", F.size(F.regexp_extract_all(text, F.lit(r"[^ \t\r\n]+"), F.lit(0))).cast("bigint")).drop(text)


def _mix_in_words(spark: SparkSession, at: str) -> Mix:
    """The same mixer over a size and a weight that SQL can express too: words, and the rating."""
    documents = table(spark, at, "documents").select("doc_id", "source", "text", "rating")
    weight = F.when(F.col("rating").between(1, 5), F.col("rating")).otherwise(0.5)
    return mix_sources(documents, "doc_id", "source", "text", weight, table(spark, at, "mix_targets"), counter=_count_words)


_MIX = r"""
WITH t AS (SELECT lower(trim(regexp_replace(source, '\s+', ' ', 'g'))) AS source, target_share, max_repeats FROM mix_targets),
d AS (SELECT doc_id, lower(trim(regexp_replace(source, '\s+', ' ', 'g'))) AS source, len(regexp_extract_all(text, '[^ \t\r\n]+')) AS tokens,
  -ln((('0x' || substr(md5(doc_id || ':3'), 1, 13))::UBIGINT::DOUBLE + 1) / 4503599627370496::DOUBLE) / CASE WHEN rating BETWEEN 1 AND 5 THEN rating ELSE 0.5::DOUBLE END AS draw
  FROM documents WHERE lower(trim(regexp_replace(source, '\s+', ' ', 'g'))) IN (SELECT source FROM t)),
a AS (SELECT t.*, coalesce(n, 0) AS have FROM t LEFT JOIN (SELECT source, sum(tokens)::BIGINT AS n FROM d GROUP BY source) USING (source)),
g AS (SELECT *, target_share * (SELECT min(max_repeats * have / target_share) FROM a WHERE target_share > 0 AND max_repeats > 0 AND have > 0) AS goal FROM a),
b AS (SELECT *, CASE WHEN have > 0 THEN least(floor(least(goal, max_repeats * have) / have), max_repeats)::INTEGER ELSE 0 END AS epochs FROM g),
r AS (SELECT *, CASE WHEN epochs < max_repeats THEN least(goal, max_repeats * have) - epochs * have ELSE 0 END AS rest FROM b),
p AS (SELECT doc_id, source, tokens, epochs, rest, sum(tokens) OVER (PARTITION BY source ORDER BY draw, doc_id ROWS UNBOUNDED PRECEDING) AS until FROM d JOIN r USING (source)),
m AS (SELECT doc_id, source, tokens::BIGINT AS tokens, epochs + CASE WHEN rest > 0 AND (until - tokens / 2 < rest OR until <= rest) THEN 1 ELSE 0 END AS copies FROM p)
"""


@query(_MIX + "SELECT doc_id, source, tokens, copies FROM m WHERE copies > 0")
def p7_mix_in_words(spark: SparkSession, at: str) -> DataFrame:
    return _mix_in_words(spark, at).rows.withColumnRenamed("key", "doc_id")


@query(
    _MIX + ", u AS (SELECT source, sum(tokens * copies)::BIGINT AS actual_tokens, count(*) AS documents FROM m WHERE copies > 0 GROUP BY source) "
    "SELECT source, target_share, max_repeats, have AS available_tokens, goal AS target_tokens, coalesce(actual_tokens, 0) AS actual_tokens, "
    "coalesce(documents, 0) AS documents, coalesce(actual_tokens, 0) / (SELECT sum(actual_tokens) FROM u) AS actual_share FROM r LEFT JOIN u USING (source)"
)
def p7_shares_in_words(spark: SparkSession, at: str) -> DataFrame:
    return _mix_in_words(spark, at).shares


_WINDOWS = "SELECT doc_id, n_chars, unnest(range(1, length(text) - 98)) AS i, text FROM documents WHERE length(text) >= 100"
_SHARED = (
    f"SELECT w.doc_id, w.i FROM (SELECT doc_id, i, md5(substring(text, i, 100)) AS s FROM ({_WINDOWS})) w "
    f"JOIN (SELECT md5(substring(text, i, 100)) AS s FROM ({_WINDOWS}) GROUP BY s HAVING min(doc_id) < max(doc_id)) USING (s)"
)


@query(f"SELECT DISTINCT doc_id FROM ({_SHARED})")
def p8_found(spark: SparkSession, at: str) -> DataFrame:
    return shared_spans(table(spark, at, "documents"), "doc_id", "text").select(F.col("key").alias("doc_id")).distinct()


@query(
    "SELECT doc_id, length(text) AS chars, coalesce(shared, 0) AS shared_chars, CASE WHEN length(text) > 0 THEN coalesce(shared, 0) / length(text) ELSE 0.0 END AS share "
    f"FROM documents LEFT JOIN (SELECT doc_id, sum(least(100, coalesce(next - i, 100)))::BIGINT AS shared FROM "
    f"(SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM ({_SHARED})) GROUP BY doc_id) USING (doc_id)"
)
def p8_shared_share(spark: SparkSession, at: str) -> DataFrame:
    return shared_share(table(spark, at, "documents"), "doc_id", "text").withColumnRenamed("key", "doc_id")
