import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitnear.llm import components
from bitnear.llm.components import connected_groups, consolidate_matches, decompose


@pytest.fixture(params=["last in one task", "all levels by joins"])
def last(request, monkeypatch):
    if request.param.startswith("all"):
        monkeypatch.setattr(components, "LAST_LINKS", 0)


def groups(pairs):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is None or b is None:
            root(b if a is None else a)
        else:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    up.pop(None, None)
    return sorted(((x, root(x)) for x in up), key=repr)


def chain(n):
    return [(i, i + 1) for i in range(n)]


@pytest.mark.parametrize(
    "pairs",
    [
        [],
        [(None, None)],
        [(5, 5), (None, 3), (-4, None)],
        chain(90),
        [(1000, i) for i in range(300)] + [(i, 1000) for i in range(50)] + [(-7, 8)] * 20,
        [(random.Random(i).randrange(300), random.Random(-i - 1).randrange(300)) for i in range(170)],
    ],
    ids=["empty", "null", "alone", "chain", "star", "random"],
)
def test_groups(spark, rows, last, pairs):
    df = spark.createDataFrame([(*p, "x") for p in pairs], "src bigint, dst bigint, vertex string")
    assert rows(connected_groups(df, "src", "dst")) == groups(pairs)


def test_records(spark, rows, last):
    rng = random.Random(2)
    some = [(rng.randrange(60), rng.randrange(60), rng.randrange(40)) for _ in range(45)]
    some = [tuple(None if rng.random() < 0.1 else x for x in r) for r in some]
    some += [(None, None, 777), (1, None, 3), (2, 2, 999), (2, 2, 999), (900, 900, None)]
    pairs = []
    for x, y, r in some:
        own = [v for v in (x, y) if v is not None] + ([10**6 + r] if r is not None else [])
        pairs += [(own[0], v) for v in own] if own else []
    least = dict(groups(pairs))
    want = {(r, least[10**6 + r] if least[10**6 + r] < 10**6 else None) for *_, r in some if r is not None}
    df = spark.createDataFrame([(*r, 1) for r in some], "hash bigint, y bigint, record bigint, x int")
    got = consolidate_matches(df, ("hash", "y"), "record")
    assert got.columns == ["record", "group_hash"] and rows(got) == sorted(want, key=repr)
    assert consolidate_matches(df.where("false"), ("hash", "y"), "record").count() == 0


@pytest.mark.parametrize("n, m", [(1, 0), (2, 1), (300, 200), (300, 900)])
def test_decomposition_in_arrays(n, m):
    rng = np.random.default_rng(n + m)
    a, b = rng.integers(0, n, m), rng.integers(0, n, m)
    a[-1:], b[-1:] = n - 1, n - 1 - (n > 1)
    roots = decompose(a, b)
    least = {}
    for v, r in enumerate(roots.tolist()):
        least.setdefault(r, v)
    want = dict(groups(list(zip(a.tolist(), b.tolist(), strict=True))))
    assert all(least[r] == want.get(v, v) for v, r in enumerate(roots.tolist()))


def test_a_hot_vertex_is_split_between_tasks(spark, rows):
    """A hub with most links: adaptive execution may split its partition in the joins, as nothing above needs the keys together."""
    from bitnear.plans.shape import physical_plan

    links = spark.range(60_000).selectExpr("IF(id % 3 > 0, -1L, id) AS src", "id + 100000 AS vertex")
    labels = spark.range(-1, 60_000).selectExpr("id AS src", "id AS center")  # as if read from a written table
    settings = {"autoBroadcastJoinThreshold": "-1", "adaptive.autoBroadcastJoinThreshold": "-1", "adaptive.advisoryPartitionSizeInBytes": "20k",
                "adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "adaptive.skewJoin.skewedPartitionFactor": "1.2"}
    try:
        for k, v in settings.items():
            spark.conf.set(f"spark.sql.{k}", v)
        sent = links.join(labels, "src").groupBy("vertex").agg(F.min("center").alias("center"))
        sent.collect()
        assert "skew=true" in physical_plan(sent)
    finally:
        for k in settings:
            spark.conf.unset(f"spark.sql.{k}")
