"""Evaluation texts inside a training corpus: an FM-index per shard of documents, searched backwards.

The text of a shard is the sequence of the words of its documents, one symbol a word, with a separator after each
document. A wavelet matrix over its Burrows-Wheeler transform answers ranks; every 16th place of a document, its first
included, is kept as a sample, from which occurrences are located by walking back. Every run of `words` words of an
evaluation text is searched, all of a block in step; the hits of a document and an item merge to spans.

A shard is a part of a scan partition, of bounded size, so documents are not shuffled. The index is a table with one row a
shard, in columns that any reader of Parquet understands, which further evaluation sets can be searched in. Evaluation texts go to the executors in blocks of bounded size.
Words are compared by 64-bit hashes.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitnear.llm.suffixes import suffix_ranks
from bitnear.runtime import Workspace, spread

#: Words of a shard; the work of a task is a few times 8 bytes times that.
SHARD_WORDS = 400_000
#: Longer texts are cut into pieces of so many windows, which overlap by a window less one word.
PIECE_WORDS = 100_000
#: Words of the evaluation texts that are broadcast at once, 8 bytes each.
BLOCK_WORDS = 1_000_000
#: Every how many places of a document one is sampled.
SAMPLE_EVERY = 16
#: Occurrences located at once, and pairs of an occurrence and an item made at once.
LOCATE_ROWS = 200_000
#: The columns of the index. Bit vectors are little-endian words of 64 bits.
INDEX = (
    "alphabet array<bigint>, less array<bigint>, planes array<binary>, zeros array<bigint>, sampled binary, samples array<int>, "
    "starts array<bigint>, doc_ids array<bigint>, offsets array<bigint>"
)
# Fixed value: what a word is.
WORD = r"[\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    """Hashes of the words of the lower-cased text."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))


class Bits:
    """A bit vector with ranks."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        ones = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.int32)

    @classmethod
    def of(cls, bits: np.ndarray) -> "Bits":
        return cls(np.packbits(np.concatenate([bits, np.zeros(64 + -len(bits) % 64, bool)]), bitorder="little").view("<u8"))

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w].astype(np.int64) + np.bitwise_count(self.words[w] & low)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)


class Wavelet:
    """A wavelet matrix: access and rank over integers, level by level from the highest bit."""

    def __init__(self, levels: list[Bits], zeros: list[int], top: int) -> None:
        self.levels, self.zeros, self.depth = levels, zeros, len(levels)
        self.base = self._down(np.arange(top + 1), np.zeros(top + 1, np.int64))

    @classmethod
    def of(cls, values: np.ndarray, top: int) -> "Wavelet":
        levels, zeros = [], []
        for level in range(max(1, int(top).bit_length()) - 1, -1, -1):
            bit = ((values >> level) & 1).astype(bool)
            levels.append(Bits.of(bit))
            zeros.append(int((~bit).sum()))
            values = np.concatenate([values[~bit], values[bit]])
        return cls(levels, zeros, top)

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, level in enumerate(self.levels):
            ones = level.rank(i)
            i = np.where((symbol >> (self.depth - 1 - k)) & 1, self.zeros[k] + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before its place i."""
        return self._down(symbol, i) - self.base[symbol]

    def symbol_and_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at place i, and its occurrences before."""
        symbol = np.zeros(len(i), np.int64)
        for k, level in enumerate(self.levels):
            bit, ones = level.get(i), level.rank(i)
            symbol = 2 * symbol + bit
            i = np.where(bit == 1, self.zeros[k] + ones, i - ones)
        return symbol, i - self.base[symbol]


@dataclass
class Shard:
    """alphabet: the words' hashes, ascending; symbol s > 0 is alphabet[s - 1], 0 a separator."""

    alphabet: np.ndarray
    less: np.ndarray
    wavelet: Wavelet
    sampled: Bits
    samples: np.ndarray
    starts: np.ndarray
    doc_ids: np.ndarray
    offsets: np.ndarray

    def row(self) -> pa.RecordBatch:
        """The shard as a row of the index."""
        numbers = {c: pa.array([getattr(self, c)]) for c in ("alphabet", "less", "samples", "starts", "doc_ids", "offsets")}
        planes = pa.array([[x.words.tobytes() for x in self.wavelet.levels]], pa.list_(pa.binary()))
        parts = numbers | {"planes": planes, "zeros": pa.array([self.wavelet.zeros], pa.list_(pa.int64())), "sampled": pa.array([self.sampled.words.tobytes()], pa.binary())}
        names = [c.split()[0] for c in INDEX.split(", ")]
        return pa.RecordBatch.from_arrays([parts[c] for c in names], names)

    @classmethod
    def from_row(cls, b: pa.RecordBatch, i: int) -> "Shard":
        alphabet, less, samples, starts, doc_ids, offsets = (np.asarray(b.column(c)[i].values) for c in ("alphabet", "less", "samples", "starts", "doc_ids", "offsets"))
        bits = lambda x: Bits(np.frombuffer(x.as_buffer(), "<u8"))
        wavelet = Wavelet([bits(x) for x in b.column("planes")[i]], b.column("zeros")[i].as_py(), len(alphabet))
        return cls(alphabet, less, wavelet, bits(b.column("sampled")[i]), samples, starts, doc_ids, offsets)


def build_shard(words: np.ndarray, lengths: np.ndarray, doc_ids: np.ndarray, offsets: np.ndarray) -> Shard:
    """Index pieces given by the words of all of them, their lengths, and the document and word they start at."""
    alphabet, symbol = np.unique(words, return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    n = int(starts[-1])
    separator = np.zeros(n, bool)
    separator[starts[1:] - 1] = True
    text = np.zeros(n, np.int64)
    text[~separator] = symbol + 1
    rank = suffix_ranks(text, separator)
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    before = text[order - 1]
    within = np.arange(n) - np.repeat(starts[:-1], lengths + 1)
    keep = (within % SAMPLE_EVERY == 0)[order]
    less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(alphabet) + 1))])
    return Shard(alphabet, less, Wavelet.of(before, len(alphabet)), Bits.of(keep), order[keep].astype(np.int32), starts[:-1], doc_ids, offsets)


def find(shard: Shard, text: np.ndarray, starts: np.ndarray, words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(phrase, place) of all occurrences of the phrases of `words` words that start at the places of text, by backward
    search, in bounded portions."""
    if not len(shard.alphabet) or not len(starts):
        return
    every = np.minimum(np.searchsorted(shard.alphabet, text), len(shard.alphabet) - 1)
    unknown = np.concatenate([[0], np.cumsum(shard.alphabet[every] != text)])
    which = np.flatnonzero(unknown[starts + words] == unknown[starts])
    every += 1
    at = starts[which]
    last = every[at + words - 1]
    low, high = shard.less[last], shard.less[last + 1]
    for j in range(words - 2, -1, -1):
        c = every[at + j]
        low, high = (shard.less[c] + shard.wavelet.rank(c, x) for x in (low, high))
        on = low < high
        which, at, low, high = which[on], at[on], low[on], high[on]
    ends = np.cumsum(high - low)
    total = int(ends[-1]) if len(ends) else 0
    for first in range(0, total, LOCATE_ROWS):
        i = np.arange(first, min(first + LOCATE_ROWS, total))
        p = np.searchsorted(ends, i, side="right")
        yield which[p], locate(shard, high[p] - (ends[p] - i))


def locate(shard: Shard, row: np.ndarray) -> np.ndarray:
    """Places in the text of rows of the suffix array: walk back to a sampled place and count the steps."""
    out, left, steps = np.zeros(len(row), np.int64), np.arange(len(row)), 0
    while len(left):
        done = shard.sampled.get(row) == 1
        out[left[done]] = shard.samples[shard.sampled.rank(row[done])] + steps
        left, row = left[~done], row[~done]
        symbol, rank = shard.wavelet.symbol_and_rank(row)
        row, steps = shard.less[symbol] + rank, steps + 1
    return out


def pieces(texts: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(key, start, words): each text with enough words, in pieces, any window of which lies within one of them."""
    own = texts.select(F.col(key).cast("bigint").alias("key"), words_of(F.col(text)).alias("all")).where(F.size("all") >= words)
    starts = F.explode(F.sequence(F.lit(0), F.size("all") - words, F.lit(PIECE_WORDS)))
    return own.select("key", "all", starts.alias("start")).select("key", "start", F.slice("all", F.col("start") + 1, PIECE_WORDS + words - 1).alias("words"))


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    lists = b.column("words")
    lengths = np.diff(np.asarray(lists.offsets)).astype(np.int64)
    return np.asarray(b.column("key")), np.asarray(b.column("start")).astype(np.int64), np.asarray(lists.flatten()), lengths


def build_index(documents: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """A table with one row per shard, see INDEX. Texts of fewer than `words` words, and null ones, can't match."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        size = 0

        def out() -> pa.RecordBatch:
            ids, starts, flat, lengths = (np.concatenate(x) for x in zip(*parts, strict=True))
            return build_shard(flat, lengths, ids, starts).row()

        for b in batches:
            ids, starts, flat, lengths = _flat(b)
            ends, at = np.cumsum(lengths), 0
            while at < len(ids):
                done = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, done + SHARD_WORDS - size, side="right")))
                parts.append((ids[at:to], starts[at:to], flat[done : int(ends[to - 1])], lengths[at:to]))
                size += int(ends[to - 1]) - done
                at = to
                if size >= SHARD_WORDS or at < len(ids):
                    yield out()
                    parts, size = [], 0
        if parts:
            yield out()

    return pieces(spread(documents.select(key, text)), key, text, words).mapInArrow(build, INDEX)


def merge_spans(doc: np.ndarray, item: np.ndarray, start: np.ndarray, words: int) -> tuple[np.ndarray, ...]:
    """(document, item, first word, word after the last) of windows that overlap or touch, merged."""
    order = np.lexsort((start, item, doc))
    doc, item, start = doc[order], item[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (start[1:] > start[:-1] + words)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], item[first], start[first], start[last] + words


def phrases_of(keys: np.ndarray, text: np.ndarray, lengths: np.ndarray, words: int) -> tuple[np.ndarray, ...]:
    """(starts, first owner of each, owners): the different phrases of pieces that lie one after the other in text.

    Equal phrases are searched once; owners[first[p] : first[p + 1]] are the keys of all pieces that have phrase p.
    """
    windows = lengths - words + 1
    at = np.arange(int(windows.sum())) + np.repeat(np.cumsum(lengths) - lengths - (np.cumsum(windows) - windows), windows)
    phrases = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, words)[at])
    _, one, same = np.unique(phrases.view(f"V{8 * words}").ravel(), return_index=True, return_inverse=True)
    pairs = np.unique(np.stack([same, np.repeat(keys, windows)]), axis=1)
    return at[one], np.searchsorted(pairs[0], np.arange(len(one) + 1)), pairs[1]


def portions(many: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of rows that stand for many[i] each, of about `most` in all, or one row."""
    ends, at = np.cumsum(many), 0
    while at < len(many):
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield slice(at, to)
        at = to


def search_index(index: DataFrame, items: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(doc_id, item_id, first, last): spans of words of a document, last exclusive, that also stand in an item.

    Spans of one document and item that overlap or touch are merged.
    """
    spark = items.sparkSession
    work = Workspace(spark, "evaluation")
    cut = work.write(pieces(items, key, text, words), "items")
    total = cut.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = max(1, -(-2 * total // BLOCK_WORDS))  # half full on average, as pieces go to blocks by hash
    schema = "doc_id bigint, item_id bigint, first bigint, last bigint"
    found = []
    for i in range(blocks):
        block = cut.where(F.pmod(F.xxhash64("key", "start"), F.lit(blocks)) == i).select("key", "start", "words").toArrow()
        parts = [_flat(b) for b in block.to_batches() if b.num_rows]
        if not parts:
            continue
        keys, _, flat, lengths = (np.concatenate(x) for x in zip(*parts, strict=True))
        shared = spark.sparkContext.broadcast((flat, *phrases_of(keys, flat, lengths, words)))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            flat, starts, owner_from, owners = shared.value
            for b in batches:
                for i in range(b.num_rows):
                    shard = Shard.from_row(b, i)
                    for phrase, place in find(shard, flat, starts, words):
                        piece = np.searchsorted(shard.starts, place, side="right") - 1
                        doc, start = shard.doc_ids[piece], place - shard.starts[piece] + shard.offsets[piece]
                        many = owner_from[phrase + 1] - owner_from[phrase]
                        for s in portions(many, LOCATE_ROWS):
                            row = np.repeat(np.arange(s.start, s.stop), many[s])
                            nth = np.arange(len(row)) - np.repeat(np.cumsum(many[s]) - many[s], many[s])
                            columns = merge_spans(doc[row], owners[owner_from[phrase[row]] + nth], start[row], words)
                            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["doc_id", "item_id", "first", "last"])

        found.append(index.mapInArrow(search, schema))
    if not found:
        return spark.createDataFrame([], schema)
    spans = work.write(reduce(DataFrame.unionAll, found), "spans")
    work.keep_only("spans")
    return _joined(spans, ["doc_id", "item_id"])


def _joined(spans: DataFrame, by: list[str], *also: Column) -> DataFrame:
    """(by, first, last, also): the spans of a group merged where they overlap or touch. also: further aggregates."""
    order = Window.partitionBy(*by).orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", (reach.isNull() | (F.col("first") > reach)).cast("int"))
    merged = marked.withColumn("span", F.sum("new").over(order)).groupBy(*by, "span")
    return merged.agg(F.min("first").alias("first"), F.max("last").alias("last"), *also).drop("span")


def leaked_spans(
    documents: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str, words: int = 12
) -> DataFrame:
    """(doc_id, item_id, first, last): where documents and items have `words` or more consecutive words in common.

    Words are the longest runs of letters and digits of the lower-cased text, counted from 0; last is exclusive. Null and
    empty texts, and those of fewer words, match nothing. Repeated texts each match. Extra columns are not read. A null
    key comes out as such. Items and documents of any length are searched whole.
    """
    work = Workspace(documents.sparkSession, "fm-index")
    index = work.write(build_index(documents, doc_key, doc_text, words), "shards")
    found = search_index(index, items, item_key, item_text, words)
    work.drop("shards")
    return found


def removal_spans(spans: DataFrame) -> DataFrame:
    """(doc_id, first, last, items): the union of a document's spans over all items, and how many items it takes in."""
    return _joined(spans, ["doc_id"], F.countDistinct("item_id").alias("items"))
