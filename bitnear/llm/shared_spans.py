"""Long stretches of text that stand in more than one record: suffix trees, partitioned by prefixes of variable length.

Every stretch of `span` characters (a window) of any record is a suffix to be placed in a tree, cut at depth `span`. To
bring equal windows together without moving each character `span` times, the suffixes are partitioned by an anchor: the
k-gram of the window that a hash ranks lowest. Equal windows have equal anchors, and neighbouring windows mostly the same
one, so a run of windows moves as one segment of text, addressed by the suffix that starts at the anchor: its prefix
of k characters is the partition.

1. Texts are cut into pieces of bounded size and the anchors of all windows computed; the pieces lie in buckets by record,
   the only time that texts are moved. Prefixes that occur in one record only hold nothing shared, and drop out.
2. Segments of the prefixes left are cut from the pieces, inside their buckets; equal segments of many copies become one.
   A prefix with one segment in several records is shared throughout, and needs no tree.
3. The others go in memory-sized groups to tasks, each of which sorts the suffixes of its group to depth `span`, which is
   the tree cut there: equal neighbours are its inner nodes at that depth, and those with two records below are shared.
   A prefix with too many segments for one task is lengthened: to the characters that all windows with the anchor in
   their first half have after it, or those with the anchor in their second half before it; where that is too frequent
   still, to the whole window, which an aggregation with map-side combine counts. Lengthened or not, characters decide.
4. The spans found are taken back to all records that have the segment, and merged there.

A prefix or segment that a large part of all records share isn't gathered: aggregations combine before the shuffle, the
other side of each join has few rows a key, and its inputs and its result are written tables, so that adaptive execution
may split a skewed partition.
"""

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitnear.llm.suffixes import window_order
from bitnear.runtime import Workspace, file_partitions, slots

#: Characters of the first prefix (a power of two).
PREFIX = 32
#: Characters of text taken up at once; longer texts are cut, with an overlap of span - 1.
PIECE_CHARS = 500_000
#: Characters of the segments of one group of prefixes.
GROUP_CHARS = 150_000
#: Different segments of one prefix that go into a tree, about 1.2 million characters; beyond, the prefix is lengthened.
PREFIX_SEGMENTS = 8_000
#: Runs of a piece that are cut at once.
CUT_ROWS = 4096
# Odd multipliers of the rolling hash, and of the last mix (those of MurmurHash3's 64-bit finaliser).
STEPS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
LOW = 20  # bits of a place in a piece


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _mix(h: np.ndarray) -> np.ndarray:
    for m in MIX:
        h = (h ^ (h >> np.uint64(33))) * np.uint64(m)
    return h ^ (h >> np.uint64(33))


def prefix_hashes(symbols: np.ndarray, width: int) -> np.ndarray:
    """A hash of the `width` symbols (a power of two) from each place on."""
    h, w = _mix(symbols.astype(np.uint64) + np.uint64(1)), 1
    while w < width:
        h = h[:-w] * np.uint64(STEPS[w.bit_length() % len(STEPS)]) + _mix(h[w:])
        w *= 2
    return _mix(h)


def anchor_runs(symbols: np.ndarray, ends: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """(first window, last window, anchor, hash of the anchor's prefix) of runs of windows with one anchor.

    symbols holds texts one after the other, ends[i] is where the text of place i ends. The anchor is the leftmost of
    those with the least hash, so it depends on nothing but the window.
    """
    n = len(symbols) - span + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 4
    h = prefix_hashes(symbols, PREFIX)
    low = np.uint64((1 << LOW) - 1)
    least, width, wanted = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1, span - PREFIX + 1
    while 2 * width <= wanted:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:n], least[wanted - width : wanted - width + n])
    start = np.flatnonzero(np.arange(n) + span <= ends[:n])
    anchor = (least[start] & low).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1) | (ends[start[1:]] != ends[start[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return start[first], start[last], anchor[first], h[anchor[first]].view(np.int64)


def pieces_of(documents: DataFrame, span: int) -> DataFrame:
    """(key, at, text, first, last, anchor, prefix) of pieces of all texts (key, text): piece by piece the runs of windows
    with one anchor, in four lists. Places count from the start of the piece, which is place `at` of the record's text."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list[tuple[int, int, str]]) -> pa.RecordBatch:
            keys, places, texts = zip(*parts, strict=True)
            lengths = np.array([len(t) for t in texts])
            ends = np.cumsum(lengths)
            first, last, anchor, prefix = anchor_runs(code_points("".join(texts)), np.repeat(ends, lengths), span)
            which = np.searchsorted(ends, first, side="right")
            borders = pa.array(np.searchsorted(which, np.arange(len(parts) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(borders, pa.array((x - (ends - lengths)[which]).astype(np.int32))) for x in (first, last, anchor)]
            columns = [pa.array(keys, pa.int64()), pa.array(places, pa.int64()), pa.array(texts, pa.string()), *lists, pa.ListArray.from_arrays(borders, pa.array(prefix))]
            return pa.RecordBatch.from_arrays(columns, ["key", "at", "text", "first", "last", "anchor", "prefix"])

        parts, size = [], 0
        for b in batches:
            for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True):
                for at in range(0, len(text) - span + 1, PIECE_CHARS):
                    piece = text[at : at + PIECE_CHARS + span - 1]
                    if parts and size + len(piece) > PIECE_CHARS + span:
                        yield out(parts)
                        parts, size = [], 0
                    parts.append((key, at, piece))
                    size += len(piece)
        if parts:
            yield out(parts)

    lists = "first array<int>, last array<int>, anchor array<int>, prefix array<bigint>"
    return documents.mapInArrow(anchors, f"key bigint, at bigint, text string, {lists}")


def tree_spans(segments: list[str], least: np.ndarray, most: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, window) of all windows under an inner node at depth `span` with two records below.

    least and most are the smallest and the largest key of the records that have the segment.
    """
    lengths = np.array([len(s) for s in segments])
    starts = np.cumsum(lengths) - lengths
    count = lengths - span + 1
    segment = np.repeat(np.arange(len(segments)), count)
    window = np.arange(len(segment)) - np.repeat(np.cumsum(count) - count, count)
    order, node = window_order(code_points("".join(segments)), starts[segment] + window, span)
    segment, window = segment[order], window[order]
    shared = np.minimum.reduceat(least[segment], node) < np.maximum.reduceat(most[segment], node)
    on = np.repeat(shared, np.diff(np.append(node, len(order))))
    return segment[on], window[on]


def _ranges(group: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, first, last) of runs of consecutive places of a group."""
    order = np.lexsort((place, group))
    group, place = group[order], place[order]
    new = np.ones(len(group), bool)
    new[1:] = (group[1:] != group[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(group))[: len(first)] - 1
    return group[first], place[first], place[last]


def shared_spans(documents: DataFrame, key: str, text: str, span: int = 100) -> DataFrame:
    """(key, first, last): stretches of a text, last exclusive and counted in code points, all of whose windows of `span`
    characters also stand in the text of another record. Stretches of a record don't overlap each other in windows, but
    may in characters; spans_by_record merges them.

    Texts are compared exactly. A repeat within one record is no case. Null and short texts share nothing; texts of any
    length are read whole; repeated texts under different keys all come out. Keys must be unique bigints; rows with a null
    key are left out. Extra columns are not read. span must be PREFIX or more. Characters decide what is equal; only the
    way back from a segment to its records goes by two 64-bit hashes of it.
    """
    if span < PREFIX:
        raise ValueError(f"span must be {PREFIX} or more")
    spark = documents.sparkSession
    work = Workspace(spark, "shared-spans")
    texts = documents.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).where(F.col("key").isNotNull() & (F.length("text") >= span))
    buckets, table = max(slots(spark), file_partitions(texts)), f"pieces_{uuid.uuid4().hex}"
    writer = pieces_of(texts.repartition(buckets, "key"), span).write.format("parquet").option("compression", "zstd").option("path", f"{work.path}/pieces")
    writer.bucketBy(buckets, "key").saveAsTable(table)
    pieces = spark.table(table)

    runs = pieces.select("key", "at", F.posexplode("prefix").alias("i", "prefix"))
    common = runs.groupBy("prefix").agg(F.min("key").alias("x"), F.max("key").alias("y")).where(F.col("x") < F.col("y")).select("prefix")
    shared = runs.join(work.write(common, "common"), "prefix", "left_semi")
    # a row for each piece, so of bounded size; partitioned by record alone, as the buckets are
    chosen = shared.repartition(buckets, "key").groupBy(F.col("key").alias("of"), F.col("at").alias("at_of")).agg(F.collect_list("i").alias("chosen"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, places = (np.asarray(b.column(c)) for c in ("key", "at"))
            bodies, chosen = b.column("text").to_pylist(), b.column("chosen")
            row = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(chosen.offsets)))
            run = np.asarray(b.column("prefix").offsets)[row] + np.asarray(chosen.flatten())
            first, last, anchor, prefix = (np.asarray(b.column(c).values)[run] for c in ("first", "last", "anchor", "prefix"))
            for at in range(0, len(run), CUT_ROWS):
                own = slice(at, at + CUT_ROWS)
                r, f = row[own], first[own]
                segments = [bodies[i][x : y + span] for i, x, y in zip(r.tolist(), f.tolist(), last[own].tolist(), strict=True)]
                columns = keys[r], places[r] + f, anchor[own] - f, prefix[own]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(segments, pa.string())], ["key", "first", "anchor", "prefix", "segment"])

    cells = pieces.join(chosen, (F.col("key") == F.col("of")) & (F.col("at") - F.col("at_of") == 0))
    cells = cells.select("key", "at", "text", "first", "last", "anchor", "prefix", "chosen")
    segments = cells.mapInArrow(cut, "key bigint, first bigint, anchor int, prefix bigint, segment string")
    segments = work.write(segments.withColumn("segment_id", F.xxhash64("segment")), "segments")
    spark.sql(f"DROP TABLE {table}")
    work.drop("pieces")

    own = ["prefix", "segment_id", "segment", "anchor"]
    different = work.write(segments.groupBy(*own).agg(F.min("key").alias("least"), F.max("key").alias("most")), "different")
    repeated = work.write(_with_sizes(different, "prefix"), "repeated")
    whole, frequent = F.col("n") == 1, F.col("n") > PREFIX_SEGMENTS
    windows = F.length("segment") - span
    direct = repeated.where(whole).select("prefix", "segment_id", F.lit(0).cast("bigint").alias("first"), windows.cast("bigint").alias("last"))
    short = repeated.where(~whole & ~frequent).select(F.col("prefix").alias("cell"), "prefix", "segment_id", F.lit(0).alias("shift"), "least", "most", "segment")

    # windows that start more than `half` before the anchor have as many characters before it, the others have them after
    half = (span - PREFIX) // 2
    border = F.greatest(F.col("anchor") - half, F.lit(0))
    piece = lambda start, length: F.substring(F.col("segment"), start + 1, length)
    before = F.struct(F.lit(0).alias("shift"), piece(F.lit(0), border + span - 1).alias("segment"), F.xxhash64(piece(F.col("anchor") - half, F.lit(half + PREFIX)), F.lit(0)).alias("cell"))
    after = F.struct(border.alias("shift"), piece(border, F.length("segment")).alias("segment"), F.xxhash64(piece(F.col("anchor"), F.lit(half + PREFIX)), F.lit(1)).alias("cell"))
    halves = repeated.where(frequent).select("prefix", "segment_id", "least", "most", F.inline(F.array(before, after)))
    halves = work.write(halves.where(F.length("segment") >= span), "halves")
    longer = work.write(_with_sizes(halves, "cell"), "longer")

    found = "prefix bigint, segment_id bigint, first bigint, last bigint"

    def trees(batch: pa.Table) -> pa.Table:
        prefix, ids, shift, least, most = (np.asarray(batch.column(c)) for c in ("prefix", "segment_id", "shift", "least", "most"))
        which, first, last = _ranges(*tree_spans(batch.column("segment").to_pylist(), least, most, span))
        return pa.table({"prefix": prefix[which], "segment_id": ids[which], "first": first + shift[which], "last": last + shift[which]})

    trees_of = short.unionByName(longer.where(~frequent).select(*short.columns))
    chars = trees_of.agg(F.sum(F.length("segment"))).first()[0] or 0
    group = F.pmod(F.xxhash64("cell", F.lit(1)), F.lit(max(1, -(-chars // GROUP_CHARS)))).alias("group")
    usual = trees_of.select(group, *short.columns).groupBy("group").applyInArrow(trees, found)

    at = F.explode(F.sequence(F.lit(0), windows)).alias("at")
    leaves = longer.where(frequent).select("prefix", "segment_id", "shift", "least", "most", "segment", at)
    leaves = work.write(leaves.select("prefix", "segment_id", "least", "most", (F.col("shift") + F.col("at")).cast("bigint").alias("first"), piece(F.col("at"), F.lit(span)).alias("leaf")), "leaves")
    met = leaves.groupBy("leaf").agg(F.min("least").alias("x"), F.max("most").alias("y")).where(F.col("x") < F.col("y")).select("leaf")
    single = leaves.join(met, "leaf", "left_semi").select("prefix", "segment_id", "first", F.col("first").alias("last"))

    spans = work.write(direct.unionByName(usual).unionByName(single), "spans").withColumnRenamed("first", "from").withColumnRenamed("last", "to")
    work.keep_only("segments", "spans")
    placed = segments.join(spans, ["segment_id", "prefix"])
    return placed.select("key", (F.col("first") + F.col("from")).alias("first"), (F.col("first") + F.col("to") + span).alias("last"))


def _with_sizes(rows: DataFrame, cell: str) -> DataFrame:
    """The written rows of the cells that hold two records, with n, the number of rows of the cell."""
    sizes = rows.groupBy(cell).agg(F.count(F.lit(1)).alias("n"), F.min("least").alias("x"), F.max("most").alias("y")).where(F.col("x") < F.col("y"))
    return rows.join(sizes.select(cell, "n"), cell)


def spans_by_record(spans: DataFrame) -> DataFrame:
    """(key, first, last): the spans of each record merged where they overlap or touch."""
    order = Window.partitionBy("key").orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", (reach.isNull() | (F.col("first") > reach)).cast("int"))
    return marked.withColumn("n", F.sum("new").over(order)).groupBy("key", "n").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("n")


def shared_share(documents: DataFrame, key: str, text: str, span: int = 100) -> DataFrame:
    """(key, chars, shared_chars, share): of every record how much of its text also stands in others; 0 if nothing does."""
    merged = spans_by_record(shared_spans(documents, key, text, span)).groupBy("key").agg(F.sum(F.col("last") - F.col("first")).alias("shared_chars"))
    own = documents.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.length(text), F.lit(0)).cast("bigint").alias("chars"))
    out = own.join(merged, "key", "left").select("key", "chars", F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"))
    return out.withColumn("share", F.when(F.col("chars") > 0, F.col("shared_chars") / F.col("chars")).otherwise(0.0))
