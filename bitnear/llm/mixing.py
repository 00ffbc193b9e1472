"""Mixing sources to target shares of tokens: Efraimidis-Spirakis sampling under token budgets.

Each source gets a budget of tokens. A budget that takes a source more than once is met with complete epochs first, all
documents alike; only the fraction left is sampled. For it every document draws an exponential key whose rate is its quality
weight (ascending keys are a weighted sample without replacement); documents are sorted by key within their source and
taken as long as the prefix sum of their tokens stays within the budget.

The quality of a text is how ordinary its tokens are: the mean surprisal of its tokens under the unigram frequencies of the
whole corpus, against the mean and the spread of all texts. Repeated phrases and templates are less surprising than the
rest, broken encoding and markup more; both count less. Each text is tokenized once, for its size and for this.

The sort is one range partitioning on (source, key), so a source of any size is spread over many tasks. The prefix sum
takes one sum per partition and source first; only the one partition of each source in which its budget ends is then
summed document by document.
"""

import base64
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitnear.runtime import Workspace, slots, spread

#: Texts tokenized at once.
ENCODE_ROWS = 500


@cache
def _encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def public_vocabulary() -> tuple[str, str]:
    """(path of a vocabulary of a public tokenizer, its split pattern); both can be given to token_counts instead."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def token_ids(documents: DataFrame, text: str, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """documents without the text, with array<int> ids and bigint tokens in its place; null and empty texts have none.

    Strings that name special tokens are ordinary text. The vocabulary's path must exist on every executor.
    """
    path, pattern = vocabulary or public_vocabulary()
    schema = documents.drop(text).withColumn("ids", F.array().cast("array<int>")).withColumn("tokens", F.lit(0).cast("bigint")).schema

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, ENCODE_ROWS):
                b = whole.slice(at, ENCODE_ROWS)
                ids = [encoder.encode_ordinary(t) if t else [] for t in b.column(text).to_pylist()]
                rest = [c for c in b.schema.names if c != text]
                columns = [*[b.column(c) for c in rest], pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [*rest, "ids", "tokens"])

    return documents.mapInArrow(encode, schema)


def surprisals(tokenized: DataFrame) -> DataFrame:
    """tokenized with a double surprisal: the mean of -log2 of the corpus frequency of a text's tokens, null without any.

    The frequencies come from all texts. They are collected, one number a token of the vocabulary, and broadcast.
    """
    counted = tokenized.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n")).toArrow()
    ids, n = (np.asarray(counted.column(c)) for c in ("id", "n"))
    bits = np.zeros(int(ids.max(initial=0)) + 1)
    bits[ids] = -np.log2(n / max(int(n.sum()), 1))
    shared = tokenized.sparkSession.sparkContext.broadcast(bits)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            lengths = np.diff(np.asarray(lists.offsets)).astype(np.int64)
            total = np.concatenate([[0.0], np.cumsum(shared.value[np.asarray(lists.flatten())])])
            ends = np.cumsum(lengths)
            mean = (total[ends] - total[ends - lengths]) / np.maximum(lengths, 1)
            yield b.append_column("surprisal", pa.array(mean, pa.float64(), mask=lengths == 0))

    return tokenized.mapInArrow(score, tokenized.withColumn("surprisal", F.lit(None).cast("double")).schema)


def quality_weight(mean: float, spread: float) -> Column:
    """From 0.05 to 1: 1 for a text of the corpus' mean surprisal, less by a normal curve for one that is off; 0.05 without tokens."""
    off = (F.col("surprisal") - F.lit(mean)) / F.lit(max(spread, 1e-9))
    return F.greatest(F.coalesce(F.exp(-off * off / 2), F.lit(0.0)), F.lit(0.05))


def normalised(source: str) -> Column:
    """Sources that differ in case or padding only are the same."""
    return F.lower(F.trim(F.regexp_replace(source, r"\s+", " ")))


def budgets(targets: list[tuple[str, float, int]], available: dict[str, int], total: float | None) -> list[tuple]:
    """(source, share, repeats, available, goal, epochs, rest) of each target. A goal out of reach is cut to what there is.

    Without a total, the mix is the largest in which every source that has tokens reaches its share.
    """
    if total is None:
        reach = [repeats * available[s] / share for s, share, repeats in targets if share > 0 and repeats > 0 and available.get(s)]
        total = min(reach, default=0.0)
    out = []
    for s, share, repeats in targets:
        have, goal = available.get(s, 0), share * total
        take = min(goal, float(repeats * have))
        epochs = min(int(take // have), repeats) if have else 0
        rest = take - epochs * have if epochs < repeats else 0.0
        out.append((s, share, repeats, have, goal, epochs, rest))
    return out


class Mix:
    """rows: (key, source, tokens, copies), copies > 0. shares: one row per target source."""

    def __init__(self, rows: DataFrame, shares: DataFrame) -> None:
        self.rows, self.shares = rows, shares


def mix_sources(
    documents: DataFrame,
    key: str,
    source: str,
    text: str,
    weight: Column | None,
    targets: DataFrame,
    total_tokens: float | None = None,
    seed: int = 3,
    counter: Callable[[DataFrame, str], DataFrame] = token_ids,
) -> Mix:
    """A mix in which each source of targets (source, target_share, max_repeats) has its share of total_tokens.

    targets is a configuration table of a few rows, read at the driver; of rows with the same normalised source, or a null
    in any column, or a negative share or repeats, an error is raised for the first and the others are left out. Documents of
    null sources, or of sources that are not targets, are not used. No document is used more than max_repeats times. Where
    a target can't be reached all there is is used, and the shares say so. Sources without documents come out with 0
    tokens. The document on the border of a budget is taken if that brings the sum nearer to it, so a share is met to
    half a document. Empty texts have 0 tokens, and are used like others. Keys must be unique bigints; the same seed
    gives the same mix. weight is an expression over the documents, None the quality described above (which needs a counter
    that gives ids); weights that are null or not positive count as 1e-9.

    The default total is the largest with which every target that has documents is reached; sources without any leave
    their share to the others in proportion.
    """
    spark = documents.sparkSession
    work = Workspace(spark, "mix")
    wanted = [tuple(r) for r in targets.select(normalised("source").alias("s"), F.col("target_share").cast("double"), F.col("max_repeats").cast("int")).collect()]
    wanted = sorted(r for r in wanted if None not in r and r[1] >= 0 and r[2] >= 0)
    if len({r[0] for r in wanted}) < len(wanted):
        raise ValueError("a source stands in the targets twice")
    names = spark.createDataFrame([(r[0],) for r in wanted], "source string")
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", "key", F.lit(seed))), 1, 13), 16, 10).cast("double")  # 52 bits
    unit = (draw + 1) / float(1 << 52)
    own = weight if weight is not None else F.lit(None).cast("double")
    rows = spread(documents.select(F.col(key).cast("bigint").alias("key"), normalised(source).alias("source"), own.cast("double").alias("w"), F.col(text).alias("text")))
    rows = work.write(counter(rows.join(F.broadcast(names), "source", "left_semi").select("key", "source", "w", "text"), "text"), "counted")
    if weight is None:
        scored = work.write(surprisals(rows).select("key", "source", "tokens", "surprisal"), "scored")
        about = scored.agg(F.mean("surprisal").alias("mean"), F.stddev("surprisal").alias("spread")).first()
        rows = scored.withColumn("w", quality_weight(about["mean"] or 0.0, about["spread"] or 0.0))
    chance = -F.log(unit) / F.greatest(F.coalesce("w", F.lit(0.0)), F.lit(1e-9))
    drawn = work.write(rows.select("key", "source", F.coalesce("tokens", F.lit(0)).alias("tokens"), chance.alias("draw")), "drawn")
    work.drop("counted")
    available = {r["source"]: r["n"] for r in drawn.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}  # a row per target
    plan = budgets(wanted, available, total_tokens)
    goals = F.broadcast(spark.createDataFrame([(s, e, r) for s, *_, e, r in plan], "source string, epochs int, rest double"))

    parts = drawn.repartitionByRange(slots(spark), "source", "draw", "key").withColumn("part", F.spark_partition_id())
    ordered = work.write(parts, "ordered")
    sums = ordered.groupBy("source", "part").agg(F.sum("tokens").alias("own"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = work.write(sums.withColumn("before", F.coalesce(F.sum("own").over(before), F.lit(0))), "sums")  # one row a partition and source
    placed = ordered.join(sums.join(goals, "source"), ["source", "part"])
    whole = (F.col("before") + F.col("own") <= F.col("rest")) & (F.col("rest") > 0)
    border = ~whole & (F.col("before") < F.col("rest"))
    running = Window.partitionBy("source", "part").orderBy("draw", "key").rowsBetween(Window.unboundedPreceding, 0)
    until = F.col("before") + F.sum("tokens").over(running)
    inside = (until - F.col("tokens") / 2 < F.col("rest")) | (until <= F.col("rest")) & (F.col("rest") > 0)
    split = placed.where(border).withColumn("copies", F.col("epochs") + inside.cast("int"))
    other = placed.where(~border).withColumn("copies", F.col("epochs") + whole.cast("int"))
    columns = ["key", "source", "tokens", "copies"]
    used = work.write(other.select(*columns).unionByName(split.select(*columns)).where(F.col("copies") > 0), "used")

    work.keep_only("used")
    got = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("actual_tokens"), F.count(F.lit(1)).alias("documents"))
    shares = spark.createDataFrame(
        [(s, share, repeats, have, goal) for s, share, repeats, have, goal, _, _ in plan],
        "source string, target_share double, max_repeats int, available_tokens bigint, target_tokens double",
    ).join(got, "source", "left")
    shares = shares.fillna(0, ["actual_tokens", "documents"])
    everything = F.sum("actual_tokens").over(Window.partitionBy())  # one row a target
    return Mix(used, shares.withColumn("actual_share", F.when(everything > 0, F.col("actual_tokens") / everything).otherwise(0.0)))
