"""The similarity join: rows of two tables whose hashes differ in at most so many bits."""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitnear.functions.bits import NO_COLUMN, NULL_DISTANCE, within
from bitnear.operators.pivot import choose_pivots
from bitnear.plans import selectivity

LEFT = ("left", "left_outer", "left_semi", "semi", "left_anti", "anti")
RIGHT = ("right", "right_outer")
FULL = ("full", "full_outer", "outer")
#: Widest distance that is searched by blocks where each row has its own distance.
WIDEST = 12

Condition = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]


def similarity_join(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str,
    distance: int | str,
    how: str = "inner",
    strategy: str = "auto",
    condition: Condition | None = None,
) -> DataFrame:
    """Join on hamming(left_on, right_on) <= distance.

    distance is an integer, or the name of a column of the right table that holds each row's own distance.
    condition(l, r), if given, takes two functions from a column's name to the column and gives a further join condition.
    Columns of the right table whose name stands in the left one too get the suffix _right (more than once if needed).

    Null hashes and null distances match nothing; a negative distance matches nothing and 64 or more every non-null
    hash; repeated rows on either side keep their multiplicity; empty tables are fine. distance=None raises.

    All strategies serve all distances and join types, and give the same rows:
    'scan' compares everything. A side of at most BROADCAST_ROWS and BROADCAST_BYTES is broadcast whole, if the join type
    lets it; else the distinct hashes are compared, of which the fewer go in blocks of BROADCAST_ROWS.
    'bands' joins distinct hashes that agree in a block of bits, but for as many bits as the distance leaves to each block,
    and verifies. Where rows have their own distances, those of similar distances are searched together; distances for
    which blocks would not pay are scanned.
    'pivot' joins distinct hashes whose distances to a pivot allow them to be near, by the triangle inequality.
    'auto' chooses between the first two by counts.
    """
    if distance is None:
        raise ValueError(NULL_DISTANCE)
    for df, c in ((left, left_on), (right, right_on), *([(right, distance)] if isinstance(distance, str) else [])):
        if c not in df.columns:
            raise ValueError(NO_COLUMN.format(c))
    if how not in ("inner", *LEFT, *RIGHT, *FULL):
        raise ValueError(f"there is no {how} join")
    if strategy not in ("scan", "bands", "pivot", "auto"):
        raise ValueError(f"there is no strategy {strategy}")
    names = {}
    for c in right.columns:
        new = c
        while new in left.columns or (new != c and new in right.columns):
            new += "_right"
        names[c] = new
    right = right.select(*[right[c].alias(names[c]) for c in right.columns])
    right_on = names[right_on]
    limit = F.lit(distance) if isinstance(distance, int) else F.col(names[distance])
    also = condition(F.col, lambda c: F.col(names[c])) if condition else None
    if strategy == "auto":
        strategy = selectivity.choose(left, right, left_on, right_on, distance) if isinstance(distance, int) else _choose_by_row(left, right)
    if isinstance(distance, int) and distance == 0 and strategy == "bands" and how not in RIGHT + FULL:
        return left.join(right, _and(F.col(left_on) == F.col(right_on), also), how)
    if strategy == "scan":
        on = _and(within(F.col(left_on), F.col(right_on), limit), also)
        if how in ("inner", *LEFT) and selectivity.fits(right):
            return left.join(F.broadcast(right), on, how)
        if how in ("inner", *RIGHT) and selectivity.fits(left):
            return F.broadcast(left).join(right, on, how).select(*left.columns, *right.columns)
    x = left.where(F.col(left_on).isNotNull()).select(F.col(left_on).alias("__a")).distinct()
    y = right.select(F.col(right_on).alias("__b"), _at_most_64(limit).alias("__d"))
    y = y.where(F.col("__b").isNotNull() & (F.col("__d") >= 0)).distinct()
    find = {"scan": _scan_pairs, "bands": _banded_pairs, "pivot": _pivot_pairs}[strategy]
    return _assemble(left, right, find(x, y, distance if isinstance(distance, int) else None), left_on, right_on, limit, how, also)


def _and(on: Column, also: Column | None) -> Column:
    return on if also is None else on & also


def _at_most_64(limit: Column) -> Column:
    """Null stays null, unlike in least()."""
    return F.when(limit > 64, F.lit(64)).otherwise(limit).cast("bigint")


def _choose_by_row(left: DataFrame, right: DataFrame) -> str:
    return "scan" if any(selectivity.few_rows(df, selectivity.FEW_ROWS) is not None for df in (right, left)) else "bands"


def _assemble(left: DataFrame, right: DataFrame, pairs: DataFrame, a: str, b: str, limit: Column, how: str, also: Column | None) -> DataFrame:
    """The join of whole rows, from the distinct pairs (__a, __b, __d) of hashes and distances that match."""
    same = (F.col(b) == F.col("__b")) & (_at_most_64(limit) == F.col("__d"))
    columns = [*left.columns, *right.columns]

    def from_left(kind: str) -> DataFrame:
        near = right.join(pairs, same).select(*right.columns, "__a")
        return left.join(near, _and(F.col(a) == F.col("__a"), also), kind)

    def from_right(kind: str) -> DataFrame:
        near = left.join(pairs, F.col(a) == F.col("__a")).select(*left.columns, "__b", "__d")
        return right.join(near, _and(same, also), kind)

    if how in RIGHT:
        return from_right("left").select(*columns)
    if how in FULL:
        alone = from_right("left_anti").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in left.schema.fields], *right.columns)
        return from_left("left").select(*columns).unionAll(alone)
    return from_left(how).drop("__a")


def _scan_pairs(x: DataFrame, y: DataFrame, distance: int | None = None) -> DataFrame:
    """Everything compared; the side with fewer hashes is broadcast in blocks of BROADCAST_ROWS (24 bytes a row). Further columns of x are carried."""
    columns = x.columns
    on = within("__a", "__b", F.col("__d"))
    most = selectivity.BROADCAST_ROWS
    for small, other in ((y, x), (x, y)):
        if selectivity.few_rows(small, most) is not None:
            return other.join(F.broadcast(small), on).select(*columns, "__b", "__d")
    n, m = x.count(), y.count()
    small, other = (x, y) if n < m else (y, x)
    blocks = -(-min(n, m) // most) * 2  # half full on average, so that uneven blocks fit too
    block = F.pmod(F.xxhash64(*small.columns), F.lit(blocks))
    return reduce(DataFrame.unionAll, [other.join(F.broadcast(small.where(block == i)), on).select(*columns, "__b", "__d") for i in range(blocks)])


def _block_pairs(x: DataFrame, y: DataFrame, most: int, blocks: int) -> DataFrame:
    """Pairs within each y's own distance, which is `most` at most. A pair is kept in the first block where it meets.

    Of a distance d, block i bears (d - i) // blocks flipped bits, and is left out where that is negative: as these numbers,
    each with one added, make up d + 1, a pair within d keeps to one of them at least. Further columns of x are carried.
    """
    columns, d = x.columns, F.col("__d")
    x = x.select("*", F.inline(selectivity.parts(F.col("__a"), blocks)))
    y = y.select("__b", "__d", F.inline(selectivity.parts(F.col("__b"), blocks)))
    y = y.withColumn("part", F.explode(selectivity.own_probes(d, F.col("band"), F.col("part"), blocks, most)))
    # exploded, y may be hundreds of times as large as Spark takes it to be, so that no choice is left to it
    y = y.select("__b", "__d", F.col("band").alias("__band"), F.col("part").alias("__part")).hint("merge")
    differ = F.col("__a").bitwiseXOR(F.col("__b"))
    meets = [F.bit_count(differ.bitwiseAND(F.lit(m))) * blocks <= d - i for i, m in enumerate(selectivity.bit_blocks(blocks))]
    first = F.coalesce(*[F.when(met, F.lit(i)) for i, met in enumerate(meets)])
    on = (F.col("band") == F.col("__band")) & (F.col("part") == F.col("__part"))
    return x.join(y, on & within("__a", "__b", d) & (first == F.col("band"))).select(*columns, "__b", "__d")


def _banded_pairs(x: DataFrame, y: DataFrame, distance: int | None) -> DataFrame:
    """By blocks, in classes of distances; what is wider than the last class is scanned."""
    if distance is not None:
        blocks = selectivity.band_plan(min(distance, 64))
        return _block_pairs(x, y, distance, blocks) if blocks else _scan_pairs(x, y)
    return reduce(DataFrame.unionAll, [*_class_pairs(x, y, selectivity.TYPICAL_ROWS), _scan_pairs(x, y.where(F.col("__d") > WIDEST))])


def _class_pairs(x: DataFrame, y: DataFrame, rows: int) -> list[DataFrame]:
    """The pairs of all distances up to WIDEST, in classes chosen for how many y have each of them."""
    counts = y.where(F.col("__d") <= WIDEST).groupBy("__d").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a distance
    plan = selectivity.class_plan({r["__d"]: r["n"] for r in counts}, rows)
    return [_block_pairs(x, y.where(F.col("__d").between(low, most)), most, blocks) for low, most, blocks in plan]


def ball_counts(rows: DataFrame, hash_column: str, balls: DataFrame, center: str, distance: str) -> DataFrame:
    """(center, distance, matches): for each different ball how many rows have a hash in it, where any has.

    Distances of 64 or more come out as 64. Such balls hold every non-null hash, which is one number for all of them, and
    no pairs are made for them. Equal hashes are compared once. Balls with a null or a negative distance or a null centre
    don't come out. Balls up to WIDEST are searched by blocks, those between by comparing everything, and each task adds
    up what it finds before anything is moved.
    """
    seen = rows.agg(F.count(hash_column).alias("all"), F.approx_count_distinct(hash_column).alias("hashes")).first()
    x = rows.where(F.col(hash_column).isNotNull()).groupBy(F.col(hash_column).alias("__a")).agg(F.count(F.lit(1)).alias("__n"))
    y = balls.select(F.col(center).cast("bigint").alias("__b"), _at_most_64(F.col(distance)).alias("__d"))
    y = y.where(F.col("__b").isNotNull() & (F.col("__d") >= 0)).distinct()
    found = [y.where(F.col("__d") == 64).select("__b", "__d", F.lit(seen["all"]).cast("bigint").alias("matches")).where("matches > 0")]
    middle = y.where((F.col("__d") > WIDEST) & (F.col("__d") < 64))
    pairs = _class_pairs(x, y, seen["hashes"])
    if not middle.isEmpty():
        pairs.append(_scan_pairs(x, middle))
    found += [p.groupBy("__b", "__d").agg(F.sum("__n").alias("matches")) for p in pairs]
    return reduce(DataFrame.unionAll, found).select(F.col("__b").alias("center"), F.col("__d").alias("distance"), "matches")


def _pivot_pairs(x: DataFrame, y: DataFrame, distance: int | None) -> DataFrame:
    """near hashes have distances to a pivot that differ by the distance at most: a join on the distance to the pivot."""
    pivot = (choose_pivots(x, "__a", 1) or [0])[0]
    away = lambda c: F.bit_count(F.col(c).bitwiseXOR(F.lit(pivot))).cast("bigint")
    x = x.withColumn("__from", away("__a"))
    reach = F.sequence(F.greatest(away("__b") - F.col("__d"), F.lit(0)), F.least(away("__b") + F.col("__d"), F.lit(64)))
    y = y.withColumn("__to", F.explode(reach)).hint("merge")  # Spark doesn't see that explode made it larger
    return x.join(y, (F.col("__from") == F.col("__to")) & within("__a", "__b", F.col("__d"))).select("__a", "__b", "__d")
