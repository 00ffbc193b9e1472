"""Nearest stored hashes of many balls: a forest of random-projection trees under one shared priority queue.

A hash is a vector of 64 signs. A tree splits it by random projections on very sparse directions, one random coordinate
each, which for vectors of signs separates near pairs least of all directions (a dense direction cuts a pair that
differs in 7 of 64 bits with probability 0.21, a coordinate with 0.11). The trees share the 64 coordinates out among
them, and no path tests a coordinate twice.

A search pushes the root of every tree with cost 0 into one queue shared by all trees. Popping a node walks down to the
leaf on the query's side and pushes the other child of each node passed, at one more than its cost. The cost of the leaf
that holds x is thus the number of coordinates on its path in which x differs from the query. As trees have no
coordinate in common, the costs of x add up to its distance at most: if x is within r, then in some tree t of T it lies
in a leaf of cost c with c * T + t <= r. The queue is ordered by just that number and read up to r, so the leaves popped
hold every hash of the ball: recall is 1 however well the trees fit, and only speed depends on the sample they are
fitted on. The candidates in the leaves are then reranked by their exact distance.

The upper levels of the trees are fitted at the driver, on a sample of bounded size. How many rows of the whole table a leaf
then holds is known from the sample, and so is the number of levels that it lacks. Those are fitted on the executors, on up
to FIT_ROWS rows of each leaf: all nodes of a level below a leaf test the same coordinate, so that a leaf's levels are a
few bytes, and the forest that is broadcast stays as small as the sample makes it while its cells keep to LEAF_ROWS rows.

As costs are small integers, the queue is an array of buckets, and whole buckets are popped at once for many queries.
Cells of clustered hashes may still hold many rows. Probes and entries both come from a shuffle on the cell and nothing above
their join needs that partitioning, so adaptive execution may split the partition of such a cell on either side.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, comb, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitnear.operators.skew import skew_join
from bitnear.runtime import Workspace, slots

#: Hashes that the upper levels are fitted on, at most; 1 MB at the driver. All hashes are indexed.
SAMPLE_ROWS = 131_072
#: Rows of the sample that a leaf of the upper levels should hold.
LEAST_SAMPLE = 64
#: Rows that the lower levels of a leaf are fitted on, about.
FIT_ROWS = 100
#: Rows of the whole table that a cell should hold.
LEAF_ROWS = 16
#: Cost of a probe and of an entry of the index, in candidates.
PROBE_COST, ENTRY_COST = 4, 3
#: Most levels below a leaf.
MOST_LEVELS = 32


@dataclass(frozen=True)
class Tree:
    """coordinate[n]: the bit that node n tests, -1 in a leaf. child[n]: the child for 0; the one for 1 follows it.

    coordinates: all bits of the tree. rows[n]: about how many rows of the whole table a leaf holds. below[n]: how many
    levels are under a leaf, which test order[n, 0], order[n, 1], ...
    """

    coordinate: np.ndarray
    child: np.ndarray
    coordinates: np.ndarray
    rows: np.ndarray
    below: np.ndarray
    order: np.ndarray


def fit_tree(sample: np.ndarray, coordinates: np.ndarray, least: float, rng: np.random.Generator) -> Tree:
    """Grow a tree level by level until its nodes hold under `least` rows of the sample or nothing splits them."""
    bits = ((sample[None, :] >> coordinates[:, None]) & 1).astype(np.float64)
    at = np.zeros(len(sample), np.int64)
    coordinate, child = [np.array([-1], np.int8)], [np.array([0], np.int32)]
    start, used = 0, np.zeros((len(coordinates), 1), bool)
    while True:
        n = used.shape[1]
        inside = at >= start
        local, b = at[inside] - start, bits[:, inside]
        size = np.bincount(local, minlength=n)
        ones = np.stack([np.bincount(local, weights=x, minlength=n) for x in b])
        share = np.minimum(ones, size - ones) / np.maximum(size, 1)
        share[used] = -1
        # among coordinates that split well, a random one; else the best there is
        pick = np.argmax(np.where(share >= 0.3, 1 + rng.random(share.shape), share), axis=0)
        split = (size > least) & (share[pick, np.arange(n)] > 0)
        if not split.any():
            whole = np.concatenate(coordinate)
            held = np.bincount(at, minlength=len(whole)).astype(np.float64)
            return Tree(whole, np.concatenate(child), coordinates, held, np.zeros(len(whole), np.int8), np.zeros((len(whole), MOST_LEVELS), np.int8))
        parents, next_start = np.flatnonzero(split), start + n
        coordinate[-1][parents] = coordinates[pick[parents]]
        child[-1][parents] = next_start + 2 * np.arange(len(parents))
        moving = split[local]
        side = b[pick[local[moving]], np.flatnonzero(moving)].astype(np.int64)
        rows = np.flatnonzero(inside)[moving]
        at[rows] = child[-1][local[moving]] + side
        used = used[:, parents].repeat(2, axis=1)
        used[pick[parents].repeat(2), np.arange(2 * len(parents))] = True
        coordinate.append(np.full(2 * len(parents), -1, np.int8))
        child.append(np.zeros(2 * len(parents), np.int32))
        start = next_start


def _depth(rows: int, leaf_rows: int, trees: int) -> int:
    return min(64 // trees, ceil(log2(max(rows / leaf_rows, 16))))


def cells_popped(radius: int, trees: int, depth: int) -> int:
    """How many cells the queue gives up to a radius."""
    return sum(comb(depth, c) for t in range(trees) for c in range(max(0, (radius - t) // trees + 1) if radius >= t else 0))


def choose_trees(rows: int, balls: dict[int, int], leaf_rows: int = LEAF_ROWS) -> int:
    """The number of trees for which entries, probes and candidates of the balls, given by radius, cost least."""

    def cost(trees: int) -> float:
        depth = _depth(rows, leaf_rows, trees)
        each = PROBE_COST + rows / 2**depth
        return ENTRY_COST * rows * trees + sum(n * each * cells_popped(min(r, 16), trees, depth) for r, n in balls.items())

    return min(range(2, 17), key=cost)


def fit_forest(sample: np.ndarray, rows: int, trees: int, leaf_rows: int = LEAF_ROWS, seed: int = 11) -> list[Tree]:
    """The upper levels of trees that share out the coordinates."""
    rng = np.random.default_rng(seed)
    groups = np.array_split(rng.permutation(64), trees)
    scale = rows / max(len(sample), 1)
    forest = [fit_tree(sample, np.sort(g), max(LEAST_SAMPLE, leaf_rows / scale if scale else 1), rng) for g in groups]
    for tree in forest:
        tree.rows[:] *= scale
    return forest


def fit_levels(hashes: np.ndarray, coordinates: np.ndarray, levels: int) -> np.ndarray:
    """Up to so many coordinates, each the one that parts the rows best that those before it have left together."""
    bits = ((hashes[None, :] >> coordinates[:, None]) & 1).astype(np.int64)
    ones = bits.sum(axis=1)
    balance = np.minimum(ones, len(hashes) - ones)
    free, chosen, cell = balance > 0, [], np.zeros(len(hashes), np.int64)
    while len(chosen) < levels and free.any():
        n = int(cell.max(initial=0)) + 1
        key = (np.arange(len(bits))[:, None] * 2 + bits) * n + cell
        parted = np.bincount(key.ravel(), minlength=2 * n * len(bits)).reshape(len(bits), 2, n).min(axis=1).sum(axis=1)
        best = int(np.argmax(np.where(free, parted * (len(hashes) + 1) + balance, -1)))
        free[best] = False
        chosen.append(coordinates[best])
        _, cell = np.unique(cell * 2 + bits[best], return_inverse=True)
    return np.array(chosen, np.int8)


def fit_below(distinct: DataFrame, forest: list[Tree], leaf_rows: int) -> None:
    """Fit the levels below the leaves on rows of the whole table, on the executors, and put them into the trees.

    What comes back is one row a leaf, and there are at most SAMPLE_ROWS / LEAST_SAMPLE * 2 leaves a tree.
    """
    spark = distinct.sparkSession
    shared = spark.sparkContext.broadcast(forest)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, draw = np.asarray(b.column("hash"), dtype=np.int64), np.asarray(b.column("draw"))
            for t, tree in enumerate(shared.value):
                leaf = leaves(tree, h)
                on = (tree.rows[leaf] > leaf_rows) & (draw * tree.rows[leaf] < FIT_ROWS)
                yield pa.RecordBatch.from_arrays([pa.array((t << 32) + leaf[on]), pa.array(h[on])], ["leaf", "hash"])

    def fit(table: pa.Table) -> pa.Table:
        leaf, h = np.asarray(table.column("leaf")), np.asarray(table.column("hash"))
        order = np.argsort(leaf, kind="stable")
        leaf, h = leaf[order], h[order]
        start = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1]]))
        out = []
        for a, b in zip(start, np.append(start[1:], len(leaf)), strict=True):
            tree, node = shared.value[leaf[a] >> 32], leaf[a] & 0xFFFFFFFF
            lacking = min(MOST_LEVELS, ceil(log2(tree.rows[node] / leaf_rows)))
            out.append(fit_levels(h[a:b], tree.coordinates, lacking).tobytes())
        return pa.table({"leaf": leaf[start], "levels": pa.array(out, pa.binary())})

    draw = F.pmod(F.xxhash64("hash", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    rows = distinct.select("hash", draw.alias("draw")).mapInArrow(place, "leaf bigint, hash bigint")
    bins = F.pmod(F.xxhash64("leaf"), F.lit(4 * slots(spark)))
    found = rows.groupBy(bins.alias("bin")).applyInArrow(fit, "leaf bigint, levels binary").toArrow()
    for leaf, levels in zip(found.column("leaf").to_pylist(), found.column("levels").to_pylist(), strict=True):
        tree, node = forest[leaf >> 32], leaf & 0xFFFFFFFF
        tree.below[node] = len(levels)
        tree.order[node, : len(levels)] = np.frombuffer(levels, np.int8)


def leaves(tree: Tree, hashes: np.ndarray) -> np.ndarray:
    """The leaf of each hash."""
    node = np.zeros(len(hashes), np.int64)
    while True:
        c = tree.coordinate[node]
        go = np.flatnonzero(c >= 0)
        if not len(go):
            return node
        node[go] = tree.child[node[go]] + ((hashes[go] >> c[go].astype(np.int64)) & 1)


def cell_number(t: int, leaf: np.ndarray, path: np.ndarray) -> np.ndarray:
    """path: the bits tested below the leaf, after a leading 1."""
    return (t << 58) + (leaf << 34) + path


def cells(tree: Tree, t: int, hashes: np.ndarray) -> np.ndarray:
    """The cell of each hash."""
    leaf = leaves(tree, hashes)
    path, below = np.ones(len(hashes), np.int64), tree.below[leaf]
    for j in range(int(below.max(initial=0))):
        on = np.flatnonzero(below > j)
        path[on] = 2 * path[on] + ((hashes[on] >> tree.order[leaf[on], j].astype(np.int64)) & 1)
    return cell_number(t, leaf, path)


def pop_all(forest: list[Tree], centers: np.ndarray, radius: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, cell) of all cells that the shared queue gives up to each query's radius."""
    trees = len(forest)
    last = int(min(radius.max(initial=-1), 64))
    queue: list[list[tuple[np.ndarray, ...]]] = [[] for _ in range(last + 1)]
    for t in range(min(trees, last + 1)):
        query = np.flatnonzero(radius >= t)
        queue[t].append((query, np.zeros(len(query), np.int64), np.ones(len(query), np.int64), np.zeros(len(query), np.int64)))
    for priority in range(last + 1):
        t = priority % trees
        tree = forest[t]
        for query, node, path, level in queue[priority]:
            while len(query):
                split = tree.coordinate[node].astype(np.int64)
                upper = split >= 0
                end = ~upper & (level >= tree.below[node])
                if end.any():
                    yield query[end], cell_number(t, node[end], path[end])
                    query, node, path, level, split, upper = (x[~end] for x in (query, node, path, level, split, upper))
                    if not len(query):
                        break
                c = np.where(upper, split, tree.order[node, np.where(upper, 0, level)])
                bit = (centers[query] >> c) & 1
                first = np.where(upper, tree.child[node], node)
                level = np.where(upper, level, level + 1)

                def side(b: np.ndarray, first=first, upper=upper, path=path) -> tuple[np.ndarray, np.ndarray]:
                    return np.where(upper, first + b, first), np.where(upper, path, 2 * path + b)

                if priority + trees <= last:
                    further = radius[query] >= priority + trees
                    other, way = side(1 - bit)
                    queue[priority + trees].append((query[further], other[further], way[further], level[further]))
                node, path = side(bit)
        queue[priority] = []


def nearest_in_balls(
    balls: DataFrame,
    center: str,
    distance: str,
    stored: DataFrame,
    hash_column: str,
    id_column: str,
    k: int,
    leaf_rows: int = LEAF_ROWS,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """(center, distance, id, hamming_distance): of each distinct ball the k stored rows nearest to its centre.

    Rows farther than the ball's distance are left out; ties go to the smaller id. Exact, see above. Balls with a null
    or a negative distance give nothing, those of 64 or more search everything (correct, at the price of reading all
    leaves). Null hashes and null ids are left out; a hash under many ids is indexed once, with its k smallest ids,
    which are all that can come out. Empty tables give no rows. Extra columns are not read. Wide balls cost more: the
    number of leaves grows as C(depth, distance / trees).
    """
    spark = stored.sparkSession
    work = Workspace(spark, "rp-forest")
    by_id = Window.partitionBy("hash").orderBy("id")
    distinct = work.write(
        stored.select(F.col(hash_column).alias("hash"), F.col(id_column).alias("id"))
        .where(F.col("hash").isNotNull() & F.col("id").isNotNull())
        .withColumn("place", F.row_number().over(by_id))
        .where(F.col("place") <= k)  # planned as a limit per group before the shuffle, so no hot hash is gathered
        .groupBy("hash")
        .agg(F.min("id").alias("id"), F.collect_list(F.when(F.col("place") > 1, F.col("id"))).alias("more")),
        "hashes",
    )
    rows = distinct.count()
    wanted = balls.select(F.col(center).cast("bigint").alias("center"), F.col(distance).cast("bigint").alias("distance"))
    wanted = wanted.where(F.col("center").isNotNull() & (F.col("distance") >= 0)).withColumn("distance", F.least("distance", F.lit(64)))
    wanted = work.write(wanted.distinct(), "balls")
    by_radius = {r["distance"]: r["n"] for r in wanted.groupBy("distance").agg(F.count(F.lit(1)).alias("n")).collect()}  # 65 rows at most
    chosen = distinct.where(F.pmod(F.xxhash64("hash", F.lit(5)), F.lit(1 << 30)) < int(min(1.0, 0.9 * sample_rows / max(rows, 1)) * (1 << 30)))
    sample = np.asarray(chosen.select("hash").limit(sample_rows).toArrow().column("hash"), dtype=np.int64)
    forest = fit_forest(sample, rows, choose_trees(rows, by_radius, leaf_rows), leaf_rows)
    fit_below(distinct, forest, leaf_rows)
    shared = spark.sparkContext.broadcast(forest)  # about 2 bytes a sampled row and tree

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.asarray(b.column("hash"), dtype=np.int64)
            for t, tree in enumerate(shared.value):
                yield pa.RecordBatch.from_arrays([b.column("hash"), b.column("id"), pa.array(cells(tree, t, h))], ["hash", "id", "cell"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, r = (np.asarray(b.column(x), dtype=np.int64) for x in ("center", "distance"))
            for at in range(0, len(c), 1024):
                for query, cell in pop_all(shared.value, c[at : at + 1024], r[at : at + 1024]):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (c[at + query], r[at + query], cell)], ["center", "distance", "cell"])

    probes = wanted.repartition(slots(spark)).mapInArrow(search, "center bigint, distance bigint, cell bigint")
    entries = distinct.select("hash", "id").mapInArrow(assign, "hash bigint, id bigint, cell bigint")
    d = F.bit_count(F.col("hash").bitwiseXOR(F.col("center"))).cast("bigint")
    # a ball has hundreds of probes, which Spark takes to be one and might broadcast
    found = probes.hint("merge").join(entries, (probes["cell"] == entries["cell"]) & (d <= F.col("distance")))
    found = found.select("center", "distance", d.alias("hamming_distance"), "hash", "id")
    # k hashes by their least ids have the k rows wanted among theirs. A hash met in several trees has the same rank each
    # time; the limit per group comes before the shuffle
    ranks = Window.partitionBy("center", "distance").orderBy("hamming_distance", "id")
    near = found.withColumn("place", F.dense_rank().over(ranks)).where(F.col("place") <= k).drop("place").distinct()
    near = work.write(near, "near")
    several = distinct.where(F.size("more") > 0).select("hash", "more")
    every = near.join(several, "hash", "left").withColumn("id", F.explode(F.concat(F.array("id"), F.coalesce("more", F.array().cast("array<bigint>")))))
    best = every.withColumn("place", F.row_number().over(ranks)).where(F.col("place") <= k)
    best = work.write(best.select("center", "distance", "id", "hamming_distance"), "nearest")
    work.keep_only("nearest")
    return best


def nearest_by_area(balls: DataFrame, key: str, center: str, distance: str, stored: DataFrame, hash_column: str, id_column: str, k: int) -> DataFrame:
    """(key, id, hamming_distance): nearest_in_balls for every row of balls, also where many rows name the same ball.

    Each different ball is searched once; a ball with very many rows is joined by broadcast of its k results.
    """
    own = balls.select(F.col(key).alias("key"), F.col(center).cast("bigint").alias("center"), F.col(distance).cast("bigint").alias("distance"))
    own = own.where(F.col("center").isNotNull() & (F.col("distance") >= 0)).withColumn("distance", F.least("distance", F.lit(64)))
    near = nearest_in_balls(own, "center", "distance", stored, hash_column, id_column, k)
    ball = F.concat_ws(":", "center", "distance").alias("ball")
    joined = skew_join(own.select("key", ball), near.select(ball, "id", "hamming_distance"), "ball")
    return joined.select("key", "id", "hamming_distance")
