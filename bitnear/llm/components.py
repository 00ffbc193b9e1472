"""One group identifier for everything linked directly or indirectly, by low-diameter decomposition.

Each level of the recursion draws an exponential shift for every vertex and lets clusters grow from shifted start times:
a vertex joins the cluster that reaches it first, counting one step a link. Clusters then contract to super-vertices,
the links between clusters (a fraction that the rate of the exponential sets) are recursed on, and the assignments of the
levels are composed.

The first round needs no join, as a start time is a function of the vertex. In each further one only vertices whose label
has changed send it on: one join of those labels with the links, and one minimum per vertex with map-side combine. A
level grows until a round changes less than SETTLED of its labels. The few vertices that a wave would still reach keep the
label they have, which names a cluster they are linked to, so the result is exact all the same.

Each level leaves a fixed fraction of the links, so after a few levels at most LAST_LINKS are left, a few MB whatever the
table's size. They are decomposed in one task, by the same method in arrays: a job for each of the last levels would cost
more than all their work. The first level is never done that way.

A vertex with very many links doesn't gather them in a task: minima are taken before each shuffle, and in each join the
other side has one row a vertex and the result is written, so that adaptive execution may split a skewed partition.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitnear.runtime import Workspace

#: Rate of the exponential shifts: larger rates give smaller clusters, fewer rounds and more links between clusters.
BETA = 0.3
#: A level stops growing when a round changes less than this share of its labels.
SETTLED = 0.03
#: Links (16 bytes each) that are decomposed in one task, once a level or more has been done by all.
LAST_LINKS = 1 << 18


def _shift(vertex: Column, level: int) -> Column:
    """Start time: minus an exponential of rate BETA, a function of vertex and level only, so a lost task repeats it."""
    unit = (F.pmod(F.xxhash64(vertex, F.lit(level)), F.lit(1 << 52)).cast("double") + 1) / float(1 << 52)
    return F.log(unit) / BETA


def _first_of(reached: DataFrame) -> DataFrame:
    """(vertex, time, center) of the wave that comes first. Equal times of different centres need a clash of 52 random
    bits; either choice is right then."""
    return reached.groupBy("vertex").agg(F.min("time").alias("time"), F.min_by("center", "time").alias("center"))


def _grow(links: DataFrame, level: int, work: Workspace) -> DataFrame:
    """(vertex, center) for every vertex of the links (a, b), which hold one direction each."""
    ends = F.inline(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("vertex")), F.struct(F.col("b").alias("src"), F.col("a").alias("vertex"))))
    both = links.select(ends)
    own = _shift(F.col("vertex"), level)
    first = _first_of(both.select("vertex", (_shift(F.col("src"), level) + 1).alias("time"), F.col("src").alias("center"))).withColumn("fresh", F.col("time") < own)
    first = first.select("vertex", F.least("time", own).alias("time"), F.when(F.col("fresh"), F.col("center")).otherwise(F.col("vertex")).alias("center"), "fresh")
    labels, i = work.write(first, f"labels-{level}-0"), 0
    total, changed = labels.agg(F.count(F.lit(1)), F.count_if("fresh")).first()
    while changed and changed >= SETTLED * total:
        news = labels.where("fresh").select(F.col("vertex").alias("src"), "time", "center")
        sent = both.join(news, "src").select("vertex", (F.col("time") + 1).alias("time"), "center", F.lit(None).cast("double").alias("had"))
        old = labels.select("vertex", "time", "center", F.col("time").alias("had"))
        best = old.unionByName(sent).groupBy("vertex").agg(F.min("time").alias("time"), F.min_by("center", "time").alias("center"), F.min("had").alias("had"))
        i += 1
        labels = work.write(best.select("vertex", "time", "center", (F.col("time") < F.col("had")).alias("fresh")), f"labels-{level}-{i}")
        changed = labels.where("fresh").count()
        work.drop(f"labels-{level}-{i - 1}")
    return labels.select("vertex", "center")


def decompose(a: np.ndarray, b: np.ndarray, seed: int = 1) -> np.ndarray:
    """The component of each vertex 0..n-1 of the links a, b, by the same method; any vertex of it names a component."""
    n = int(max(a.max(initial=-1), b.max(initial=-1))) + 1
    rng, names, levels = np.random.default_rng(seed), n, []
    while len(a):
        src, dst = np.concatenate([a, b]), np.concatenate([b, a])
        time, center = -rng.exponential(1 / BETA, names), np.arange(names)
        while True:
            sent = time[src] + 1
            best = time.copy()
            np.minimum.at(best, dst, sent)
            if not (best < time).any():
                break
            won = (sent == best[dst]) & (best < time)[dst]
            came = center[src[won]]
            center[dst[won]] = came
            time = best
        levels.append(center)
        a, b = center[a], center[b]
        on = a != b
        a, b = a[on], b[on]
    out = np.arange(n)
    for center in levels:
        out = center[out]
    return out


def _last(links: DataFrame) -> DataFrame:
    """(vertex, center) of at most LAST_LINKS links (a, b), in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [x for x in batches if x.num_rows]
        if own:
            a, b = (np.concatenate([np.asarray(x.column(c)) for x in own]) for c in ("a", "b"))
            names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            center = names[decompose(at[: len(a)], at[len(a) :])]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(center)], ["vertex", "center"])

    return links.coalesce(1).mapInArrow(run, "vertex bigint, center bigint")


def _linked_groups(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """(vertex, group) for every value that is linked to another one."""
    work = Workspace(pairs.sparkSession, "components")
    pairs = pairs.select(F.col(x).alias("x"), F.col(y).alias("y")).where(F.col("x") != F.col("y"))
    links = work.write(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links-0")
    levels: list[DataFrame] = []
    while n := links.count():
        i = len(levels)
        if i and n <= LAST_LINKS:
            levels.append(work.write(_last(links), f"labels-{i}-last"))
            break
        levels.append(_grow(links, i, work))
        p, q = (levels[-1].select(F.col("vertex").alias(end), F.col("center").alias(name)) for end, name in (("a", "x"), ("b", "y")))
        between = links.join(p, "a").join(q, "b").where(F.col("x") != F.col("y"))
        links = work.write(between.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"links-{i + 1}")
        work.drop(f"links-{i}")
    if not levels:
        return pairs.select(F.col("x").alias("vertex"), F.col("y").alias("group"))
    roots = levels[-1]
    for i in range(len(levels) - 2, -1, -1):
        up = roots.select(F.col("vertex").alias("center"), F.col("center").alias("root"))
        roots = work.write(levels[i].join(up, "center", "left").select("vertex", F.coalesce("root", "center").alias("center")), f"roots-{i}")
    least = roots.groupBy("center").agg(F.min("vertex").alias("group"))
    groups = work.write(roots.join(work.write(least, "least"), "center").select("vertex", "group"), "groups")
    work.keep_only("groups")
    return groups


def connected_groups(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(vertex, group): for every non-null value of the bigint columns a and b the least value it is linked to.

    A row links its two values; a row with a null only names the other value. Repeated rows, loops and either direction
    are fine; empty tables give no rows. Extra columns are not read.
    """
    both = pairs.select(F.col(a).alias("a"), F.col(b).alias("b"))
    named = both.select(F.explode(F.array("a", "b")).alias("vertex")).where(F.col("vertex").isNotNull()).distinct()
    return named.join(_linked_groups(both, "a", "b"), "vertex", "left").select("vertex", F.coalesce("group", "vertex").alias("group"))


def consolidate_matches(matches: DataFrame, hashes: tuple[str, str], record: str) -> DataFrame:
    """(record, group_hash): one row per distinct non-null record, with the least hash it is linked to in any way.

    Each row links its non-null values; the two hash columns name things of one kind, records are a kind of their own.
    A record without any hash gets null. All other cases as in connected_groups.

    A record and the hashes of its rows are in one group, so it is first replaced by the least of them. A row whose least
    hash is another one links the two; the links left are between hashes only.
    """
    x, y = hashes
    rows = matches.select(F.col(x).alias("x"), F.col(y).alias("y"), F.col(record).alias("record"))
    work = Workspace(matches.sparkSession, "records")
    named = rows.where(F.col("record").isNotNull()).select("record", F.least("x", "y").alias("x"))  # least() skips nulls
    first = named.groupBy("record").agg(F.min("x").alias("hash"), F.max("x").alias("other"))
    first = work.write(first.withColumn("several", F.coalesce(F.col("hash") < F.col("other"), F.lit(False))).drop("other"), "first")
    several = first.where("several").select("record", F.col("hash").alias("y"))
    through = named.join(several, "record").where(F.col("x") != F.col("y")).select("x", "y")
    direct = rows.where(F.col("x") != F.col("y")).select("x", "y")
    groups = _linked_groups(direct.unionByName(through), "x", "y").withColumnRenamed("vertex", "hash")
    return first.join(groups, "hash", "left").select("record", F.coalesce("group", "hash").alias("group_hash"))
