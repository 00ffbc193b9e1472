import random

import numpy as np
import pytest

from bitnear.llm import shared_spans as module
from bitnear.llm.shared_spans import anchor_runs, code_points, shared_share, shared_spans, spans_by_record, tree_spans


def brute(docs, span):
    where = {}
    for k, t in docs:
        for i in range(len(t or "") - span + 1):
            where.setdefault(t[i : i + span], set()).add(k)
    out = {}
    for k, t in docs:
        for i in range(len(t or "") - span + 1):
            if len(where[t[i : i + span]]) > 1:
                out.setdefault(k, set()).update(range(i, i + span))
    return out


def test_anchors_depend_on_the_window_only():
    rng = random.Random(1)
    common = "".join(rng.choice("abc é😀") for _ in range(150))
    seen = []
    for before in ("", "xyz", "qq" * 40):
        text = code_points(before + common + before)
        first, last, anchor, prefix = anchor_runs(text, np.full(len(text), len(text)), 100)
        assert first[0] == 0 and last[-1] == len(text) - 100 and (first[1:] == last[:-1] + 1).all()
        assert (anchor >= last).all() and (anchor + 32 <= first + 100).all()
        each = np.repeat(prefix, last - first + 1)
        seen.append(each[len(before) : len(before) + 51].tolist())
    assert seen[0] == seen[1] == seen[2]
    assert [len(x) for x in anchor_runs(text[:99], np.full(99, 99), 100)] == [0, 0, 0, 0]


def test_a_tree_counts_records_not_occurrences():
    segment, window = tree_spans(["abcdefgh" * 3, "zabcdefghab"], np.array([1, 1]), np.array([1, 1]), 8)
    assert not len(segment)
    segment, window = tree_spans(["xabcdefghx", "zabcdefghab", "zzzzzzzzz"], np.array([1, 2, 3]), np.array([1, 2, 3]), 8)
    assert sorted(zip(segment.tolist(), window.tolist(), strict=True)) == [(0, 1), (1, 1)]


@pytest.mark.parametrize("small", [False, True])
def test_same_as_brute_force(spark, rows, monkeypatch, small):
    if small:  # many pieces and groups, and prefixes that are lengthened
        for name, n in (("PIECE_CHARS", 300), ("GROUP_CHARS", 500), ("PREFIX_SEGMENTS", 3), ("CUT_ROWS", 2)):
            monkeypatch.setattr(module, name, n)
    rng = random.Random(3)
    some = lambda n: "".join(rng.choice("ab cdeé😀\n") for _ in range(n))
    template = some(260)
    docs = [(i, some(rng.randrange(200))) for i in range(30)]
    docs += [(100 + i, some(rng.randrange(150)) + template[rng.randrange(60) : 200 + rng.randrange(60)] + some(rng.randrange(40))) for i in range(30)]
    docs += [(200 + i, docs[40][1]) for i in range(25)] + [(300, some(120) * 4), (301, " " * 150), (302, " " * 400), (303, ""), (304, None), (305, "short")]
    docs += [(306, template[:99]), (307, template[:100]), (308, template.upper()), (309, some(3000) + template + some(50))]
    want = brute(docs, 100)
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id bigint, text string, key int, first int").repartition(3)
    spans = shared_spans(df, "doc_id", "text")
    got = {}
    for k, a, b in rows(spans):
        assert b - a >= 100
        got.setdefault(k, set()).update(range(a, b))
    assert got == want
    merged = rows(spans_by_record(spans))
    assert sum(b - a for _, a, b in merged) == sum(map(len, want.values()))
    share = {r["key"]: (r["chars"], r["shared_chars"]) for r in shared_share(df, "doc_id", "text").collect()}
    assert share == {k: (len(t or ""), len(want.get(k, ()))) for k, t in docs}


def test_edges(spark):
    df = spark.createDataFrame([(1, "x" * 200), (None, "x" * 200)], "k bigint, t string")
    assert shared_spans(df, "k", "t").count() == 0
    assert shared_spans(df.where("false"), "k", "t").count() == 0
    assert shared_share(df.where("false"), "k", "t").count() == 0
    with pytest.raises(ValueError):
        shared_spans(df, "k", "t", 20)
