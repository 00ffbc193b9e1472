import random

import numpy as np
import pytest
import regex

from bitnear.llm import fm_index
from bitnear.llm.fm_index import Bits, Shard, Wavelet, build_shard, find, leaked_spans, merge_spans, phrases_of, portions, removal_spans
from bitnear.llm.suffixes import suffix_ranks, window_order


def words(text):
    return regex.findall(r"[\p{L}\p{N}]+", text.lower())


def test_bits_and_wavelet():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 1000):
        own = rng.random(n) < 0.4
        b, i = Bits.of(own), np.arange(n + 1)
        assert (b.rank(i) == np.concatenate([[0], np.cumsum(own)])).all() and (b.get(i[:n]) == own).all()
    values = rng.integers(0, 37, 500)
    w = Wavelet.of(values, 40)
    for s in (0, 5, 36, 40):
        assert (w.rank(np.full(501, s), np.arange(501)) == np.concatenate([[0], np.cumsum(values == s)])).all()
    symbol, rank = w.symbol_and_rank(np.arange(500))
    assert (symbol == values).all() and all(rank[i] == (values[:i] == values[i]).sum() for i in range(500))


def test_suffixes():
    text = np.array([3, 3, 1, 9, 3, 3, 1, 2, 9, 1, 9])
    end = text == 9
    split = lambda i: [(0, j) if end[j] else (1, int(text[j])) for j in range(i, len(text))]
    assert np.argsort(suffix_ranks(text, end)).tolist() == sorted(range(len(text)), key=split)


@pytest.mark.parametrize("symbols", [1, 2, 30, 400, 60_000])
@pytest.mark.parametrize("width", [1, 2, 7, 40, 100])
def test_suffixes_cut_at_a_depth(symbols, width):
    rng = np.random.default_rng(width)
    text = rng.integers(0, symbols, 700).astype(np.uint32)
    text[300:500] = text[:200]
    places = np.flatnonzero(rng.random(len(text) - width + 1) < 0.7)
    order, border = window_order(text, places, width)
    own = [tuple(text[i : i + width].tolist()) for i in places[order]]
    assert own == sorted(own)
    assert border.tolist() == [i for i in range(len(own)) if not i or own[i] != own[i - 1]]
    assert [len(x) for x in window_order(text[:0], places[:0], width)] == [0, 0]


def test_search_and_locate():
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 6, n) for n in (0, 1, 5, 40, 300, 300)] + [np.full(50, 2)]
    lengths = np.array([len(d) for d in docs])
    shard = build_shard(np.concatenate(docs), lengths, np.arange(len(docs)), np.zeros(len(docs), np.int64))
    phrases = np.array([docs[4][10:14], docs[5][-4:], [2, 2, 2, 2], [0, 1, 9, 1], docs[3][:4]])
    shard = Shard.from_row(shard.row(), 0)
    got = sorted((int(p), int(at)) for a, b in find(shard, phrases.ravel(), np.arange(0, phrases.size, 4), 4) for p, at in zip(a, b, strict=True))
    want = sorted((p, int(shard.starts[d]) + i) for p, x in enumerate(phrases) for d, own in enumerate(docs) for i in range(len(own) - 3) if (own[i : i + 4] == x).all())
    assert got == want


def test_merging():
    doc, item, start = np.array([1, 1, 1, 2, 1]), np.array([7, 7, 7, 7, 8]), np.array([5, 0, 1, 1, 1])
    assert [x.tolist() for x in merge_spans(doc, item, start, 4)] == [[1, 1, 2], [7, 8, 7], [0, 1, 1], [9, 5, 5]]


def test_equal_phrases_have_all_their_owners():
    text, lengths = np.array([1, 2, 3, 4, 2, 3, 4, 2, 3]), np.array([4, 3, 2])
    starts, first, owners = phrases_of(np.array([10, 20, 30]), text, lengths, 2)
    got = {tuple(text[s : s + 2]): owners[first[i] : first[i + 1]].tolist() for i, s in enumerate(starts)}
    assert got == {(1, 2): [10], (2, 3): [10, 20, 30], (3, 4): [10, 20]}


def test_portions_are_bounded():
    many = np.array([3, 1, 9, 1, 1, 1, 2])
    assert [many[s].tolist() for s in portions(many, 4)] == [[3, 1], [9], [1, 1, 1], [2]]
    assert list(portions(many[:0], 4)) == []


@pytest.mark.parametrize("small", [False, True])
def test_same_as_brute_force(spark, rows, monkeypatch, small):
    if small:  # many shards, pieces and blocks
        for name, n in (("SHARD_WORDS", 300), ("PIECE_WORDS", 40), ("BLOCK_WORDS", 60), ("LOCATE_ROWS", 7)):
            monkeypatch.setattr(fm_index, name, n)
    rng = random.Random(5)
    vocabulary = ["été", "Straße", "日本", "don", "t", "x1", "42", "İzmir", "ΟΔΟΣ", "ab", "cd", "ef"]
    sentence = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(sentence(rng.randrange(4, 30)))) for i in range(25)]
    items += [(100, items[0][1]), (101, None), (102, ""), (103, "ab " * 30), (104, " ".join(sentence(11)))]
    docs = []
    for i in range(60):
        body = sentence(rng.randrange(60))
        if i % 3 == 0:
            own = words(rng.choice(items)[1] or "")
            body[3:3] = own[rng.randrange(3) : len(own) - rng.randrange(3)]
        docs.append((i, rng.choice([" ", "\n", "... ", "-"]).join(body)))
    docs += [(200, None), (201, ""), (202, "ab " * 2000), (203, items[3][1].upper())] + [(300 + i, items[0][1]) for i in range(40)]
    run = lambda text: [tuple(w[i : i + 8]) for w in [words(text or "")] for i in range(len(w) - 7)]
    want = sorted({(d, i) for i, t in items for d, u in docs if set(run(t)) & set(run(u))}, key=repr)
    left = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, words int").repartition(3)
    right = spark.createDataFrame([(*i, 1) for i in items], "item_id bigint, text string, start int")
    spans = leaked_spans(left, "doc_id", "text", right, "item_id", "text", 8)
    assert rows(spans.select("doc_id", "item_id").distinct()) == want
    bodies = {d: words(u or "") for d, u in docs}
    hits = {(d, i, at) for i, t in items for d, u in docs for at, x in enumerate(run(u)) if x in set(run(t))}
    own = rows(spans)
    assert all(x[:2] != y[:2] or x[3] < y[2] or y[3] < x[2] for x in own for y in own if x != y)  # merged, across pieces and portions too
    covered = {(d, i, at) for d, i, a, b in rows(spans) for at in range(a, b - 7)}
    assert covered == hits and all(b <= len(bodies[d]) for d, _, _, b in rows(spans))
    merged = rows(removal_spans(spans).select("doc_id", "first", "last"))
    assert {(d, w) for d, a, b in merged for w in range(a, b)} == {(d, at + k) for d, _, at in hits for k in range(8)}
    assert all(x[0] != y[0] or x[2] < y[1] or y[2] < x[1] for x in merged for y in merged if x != y)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    items = spark.createDataFrame([(2, "a b c")], "item_id bigint, text string")
    call = lambda d, i: leaked_spans(d, "doc_id", "text", i, "item_id", "text", 2).count()
    assert (call(docs, items), call(docs.where("false"), items), call(docs, items.where("false"))) == (1, 0, 0)
    assert removal_spans(leaked_spans(docs, "doc_id", "text", items.where("false"), "item_id", "text")).count() == 0
