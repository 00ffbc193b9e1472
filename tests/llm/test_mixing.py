import math
import random

import pytest
from pyspark.sql import functions as F

from bitnear.llm.mixing import budgets, mix_sources, surprisals, token_ids

SCHEMA = "doc_id bigint, source string, text string, rating int, tokens string"


def by_words(df, text):
    return df.withColumn("tokens", F.when(F.trim(text) == "", 0).otherwise(F.size(F.split(F.trim(text), " "))).cast("bigint")).drop(text)


@pytest.fixture
def documents(spark):
    own = [(i, ["web", " WEB", "Web "][i % 3], "w " * (1 + i % 7), 5, "t") for i in range(900)]
    own += [(1000 + i, "forum", "w " * 5, None, "t") for i in range(60)] + [(2000 + i, "tiny", "w w", 9, "t") for i in range(4)]
    own += [(3000, None, "w", 1, "t"), (3001, "other", "w", 1, "t"), (3002, "web", None, 1, "t"), (3003, "tiny", "", None, "t"), (3004, "forum", "long " * 300, 1, "t")]
    return spark.createDataFrame(own, SCHEMA)


def mix(spark, documents, targets, total=None, **options):
    wanted = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    return mix_sources(documents, "doc_id", "source", "text", F.when(F.col("rating").between(1, 5), 1.0).otherwise(0.5), wanted, total, counter=by_words, **options)


def test_budgets():
    targets = [("a", 0.5, 2), ("b", 0.3, 1), ("c", 0.2, 9)]
    assert budgets(targets, {"a": 100, "b": 1000, "c": 10}, 400) == [("a", 0.5, 2, 100, 200.0, 2, 0.0), ("b", 0.3, 1, 1000, 120.0, 0, 120.0), ("c", 0.2, 9, 10, 80.0, 8, 0.0)]
    assert budgets([("a", 0.5, 2), ("b", 0.5, 1)], {"a": 10}, None) == [("a", 0.5, 2, 10, 20.0, 2, 0.0), ("b", 0.5, 1, 0, 20.0, 0, 0.0)]
    assert budgets([], {}, None) == []


def test_shares_are_met_where_they_can_be(spark, documents):
    out = mix(spark, documents, [("Web", 0.7, 1), ("forum ", 0.2, 3), ("none", 0.1, 2)], 3000)
    got = {r["source"]: r for r in out.shares.collect()}
    assert abs(got["web"]["actual_tokens"] - 2100) <= 7 and abs(got["forum"]["actual_tokens"] - 600) <= 150
    assert got["none"]["actual_tokens"] == got["none"]["documents"] == 0 and got["none"]["available_tokens"] == 0
    rows = out.rows.collect()
    assert len({r["key"] for r in rows}) == len(rows)
    for s, r in got.items():
        own = [x for x in rows if x["source"] == s]
        assert sum(x["tokens"] * x["copies"] for x in own) == r["actual_tokens"] and len(own) == r["documents"]
        assert all(1 <= x["copies"] <= r["max_repeats"] for x in own)
    assert abs(sum(r["actual_share"] for r in got.values()) - 1) < 1e-9


def test_complete_epochs_come_first_and_caps_hold(spark, documents):
    out = mix(spark, documents, [("tiny", 0.9, 3), ("forum", 0.1, 2)], 10_000)
    tiny = [r for r in out.rows.collect() if r["source"] == "tiny"]
    assert {r["copies"] for r in tiny} == {3} and len(tiny) == 5
    share = {r["source"]: r for r in out.shares.collect()}["tiny"]
    assert share["actual_tokens"] == 24 < share["target_tokens"]
    out = mix(spark, documents, [("tiny", 0.9, 30), ("forum", 0.1, 2)], 44)
    assert {r["copies"] for r in out.rows.collect() if r["source"] == "tiny"} == {4, 5}


def test_the_same_seed_gives_the_same_mix_and_weights_count(spark, documents):
    one, two, other = (sorted(r["key"] for r in mix(spark, documents, [("web", 1.0, 1)], 800, seed=s).rows.collect()) for s in (1, 1, 2))
    assert one == two != other
    heavy = F.when(F.col("doc_id") % 2 == 0, 50.0).otherwise(F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(0.1))
    wanted = spark.createDataFrame([("web", 1.0, 1)], "source string, target_share double, max_repeats int")
    keys = [r["key"] for r in mix_sources(documents, "doc_id", "source", "text", heavy, wanted, 800, counter=by_words).rows.collect()]
    assert sum(k % 2 == 0 for k in keys) > 0.9 * len(keys)


def test_edges(spark, documents):
    targets = [("web", 1.0, 1)]
    assert mix(spark, documents.where("false"), targets).rows.count() == 0
    assert mix(spark, documents, targets[:0] or [("x", None, 1)]).rows.count() == 0
    assert mix(spark, documents, [("web", 1.0, 0)], 10).rows.count() == 0
    assert [tuple(r)[:2] for r in mix(spark, documents.where("false"), targets).shares.collect()] == [("web", 1.0)]
    with pytest.raises(ValueError):
        mix(spark, documents, [("web", 0.5, 1), (" WEB", 0.5, 1)])


def test_tokens_of_a_public_tokenizer(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "<|endoftext|>"), (5, "a" * 20_000)], "id bigint, text string")
    got = {r["id"]: r["tokens"] for r in token_ids(df, "text").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1 and 0 < got[5] < 20_000


def test_surprisal_is_that_of_the_corpus_frequencies(spark):
    lists = [[1, 1, 2], [], [2, 3, 3, 3], [7], None]
    df = spark.createDataFrame([(i, x or []) for i, x in enumerate(lists)], "k bigint, ids array<int>")
    every = [t for x in lists for t in x or []]
    want = [sum(-math.log2(every.count(t) / len(every)) for t in x) / len(x) if x else None for x in lists]
    got = [r["surprisal"] for r in surprisals(df).orderBy("k").collect()]
    assert [x if x is None else round(x, 9) for x in got] == [x if x is None else round(x, 9) for x in want]


def test_unusual_texts_are_taken_less_often(spark):
    """Ordinary reviews, one phrase repeated, and broken encoding: of a quarter of the tokens the ordinary get more than their part."""
    rng = random.Random(1)
    words = ["the", "room", "was", "clean", "and", "food", "good", "staff", "we", "came", "late", "but", "liked", "it", "very", "much"]
    own = [(i, "web", " ".join(rng.choices(words, k=40))) for i in range(300)]
    own += [(1000 + i, "web", "buy now " * 20) for i in range(100)] + [(2000 + i, "web", "\u00c3\u00a9\u00e2\u20ac" * 20 + str(i)) for i in range(50)]
    df = spark.createDataFrame(own, "id bigint, source string, text string")
    wanted = spark.createDataFrame([("web", 1.0, 1)], "source string, target_share double, max_repeats int")
    whole = mix_sources(df, "id", "source", "text", None, wanted).rows.collect()
    taken = mix_sources(df, "id", "source", "text", None, wanted, sum(r["tokens"] for r in whole) / 4).rows.collect()
    ordinary = lambda rows: sum(r["key"] < 1000 for r in rows) / len(rows)
    assert len(whole) == len(own) and ordinary(taken) > ordinary(whole) + 0.05
