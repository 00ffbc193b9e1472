"""Joins and per-key results where a few keys hold most rows.

Heavy keys are found with a frequent-items sketch over all rows, so their number is bound by the threshold. They go
through a broadcast join, where no key is gathered in one task; the rest goes through an ordinary shuffle; the two
results are put together by union.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitnear.plans.selectivity import fits

#: A key is heavy from this share of the rows on.
HEAVY_SHARE = 0.002
#: Items the sketch tracks. Its error is at most about rows / (0.75 * tracked / 3.5), well under HEAVY_SHARE.
TRACKED = 8192
#: Rows, and bytes of them, of the other side that may be broadcast for the heavy keys.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
#: Pieces into which a heavy key is salted where the other side is heavy too.
SALTS = 64


def heavy_keys(df: DataFrame, key: str, share: float = HEAVY_SHARE, tracked: int = TRACKED) -> DataFrame:
    """A table with the one column key: all keys that hold the share of rows or more, at most about 1 / share of them."""
    found = heavy_key_list(df, key, share, tracked)
    return df.sparkSession.createDataFrame([(k,) for k in found], f"`{key}` {df.schema[key].dataType.simpleString()}")


def heavy_key_list(df: DataFrame, key: str, share: float = HEAVY_SHARE, tracked: int = TRACKED) -> list:
    """The keys of heavy_keys as a list.

    One pass, with sketches merged map-side. Keys close below the share may be among them; that changes no result of
    the operators here. Null keys are left out. The key may be of any atomic type.
    """
    keys = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"))
    most = max(1, int(2 / share))
    found = keys.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(k, {min(most, tracked)}, {tracked})").alias("top")).first()
    return [x["item"] for x in found["top"] or [] if x["count"] >= share * found["n"]]


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", share: float = HEAVY_SHARE) -> DataFrame:
    """left join right on the column key, which both have, without a task that holds all rows of a heavy key.

    Columns of the right table that the left one has too get the suffix _right. how is inner, left, left_semi or
    left_anti. Null keys match nothing. Each pair comes out once, as in a plain join; repeated rows stay repeated.

    Rows of the right side with keys heavy on the left are broadcast if they are few; else the heavy part is joined on
    (key, salt), the left rows spread over the salts and the right rows repeated for each.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"skew_join can't do a {how} join")
    taken = set(left.columns) | set(right.columns)
    names = {c: c for c in right.columns}
    for c in right.columns:
        while c != key and names[c] in left.columns or names[c] != c and names[c] in taken:
            names[c] += "_right"
    right = right.select(*[F.col(c).alias(names[c]) for c in right.columns])
    hot = heavy_keys(left, key, share)
    if hot.isEmpty():
        return left.join(right, key, how)
    hot = F.broadcast(hot)
    few = right.join(hot, key, "left_semi")
    light = left.join(hot, key, "left_anti").join(right.join(hot, key, "left_anti"), key, how)
    if fits(few, BROADCAST_ROWS, BROADCAST_BYTES):
        return left.join(hot, key, "left_semi").join(F.broadcast(few), key, how).unionByName(light)
    salted = left.join(hot, key, "left_semi").withColumn("__salt", F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int"))
    many = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(many, [key, "__salt"], how).drop("__salt").unionByName(light)


def per_key_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_result: tuple[str, Column],
    right_result: tuple[str, Column],
    share: float = HEAVY_SHARE,
) -> DataFrame:
    """(key, left result, right result) for every non-null key for which both are non-null.

    A result is (name, aggregate expression). Either table is aggregated per key: heavy keys where their rows lie, with
    only one partial row per key and task moved, then joined by broadcast, as there are at most a few thousand of them;
    the remaining keys by an ordinary shuffle on the key, which the join then uses again. Empty tables give no rows.
    """
    hot = F.broadcast(heavy_keys(left, key, share).union(heavy_keys(right, key, share)).distinct())

    def result(df: DataFrame, out: tuple[str, Column], kind: str) -> DataFrame:
        rows = df.where(F.col(key).isNotNull()).join(hot, key, kind)
        name, aggregate = out
        return rows.groupBy(key).agg(aggregate.alias(name)).where(F.col(name).isNotNull())

    heavy = result(left, left_result, "left_semi").join(F.broadcast(result(right, right_result, "left_semi")), key)
    light = result(left, left_result, "left_anti").join(result(right, right_result, "left_anti"), key)
    return heavy.unionByName(light)
