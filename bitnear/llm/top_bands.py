"""The first N rows of every group, by descending bands of the score.

Rows are put into bands by ranges of the score. The borders are quantiles of all rows' scores, from a sketch that is merged
map-side, so the score may be any number: the first band holds about what the groups need in all, each further one twice
as much as the one above. The bands are written as partitions of one table and processed from the top. Groups that are
full are taken out of a band by an anti-join before anything of it is ranked; the rest take their first rows in exact
order, with ties at the borders of what they need decided by the order given. As soon as no group has rows left below, the
lower bands are never read.

Within a band each task keeps at most N rows of a group before anything is shuffled, so a group of any size costs no task
more than its share.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitnear.runtime import Workspace

#: Most bands a table is cut into; each lower one holds twice the rows of the one above.
BANDS = 4
#: Quantiles that borders are taken from; one is off by half a step at most, which changes no result.
GRID = 512


def band_shares(rows: int, wanted: int, most: int = BANDS) -> list[float]:
    """The share of all rows above each border: the first band takes `wanted` rows, each further one twice the last."""
    shares, goal = [], wanted
    while goal < rows and len(shares) < most - 1:
        shares.append(goal / rows)
        goal = 3 * goal if len(shares) == 1 else 2 * goal + wanted
    return shares


def top_in_groups(rows: DataFrame, group: str, n: int, badness: Column, order: list[str]) -> DataFrame:
    """Of the distinct rows, the first n of each group by badness (any number, ascending), then `order`.

    Repeated rows count once. Rows with a null in any column or in badness are left out, NaN comes last. The order must be
    total over the distinct rows of a group, which holds if it names all other columns. Groups with fewer rows come out
    with those they have; an empty table gives no rows. badness may name any of the columns, whose names must not begin
    with two underscores.
    """
    work = Workspace(rows.sparkSession, "top-bands")
    columns = rows.columns
    whole = reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])
    kept = rows.where(whole).withColumn("__badness", badness).where(F.col("__badness").isNotNull())
    grid = [(i + 1) / GRID for i in range(GRID)]
    about = kept.agg(
        F.count(F.lit(1)).alias("rows"), F.approx_count_distinct(group).alias("groups"), F.percentile_approx("__badness", grid, 2 * GRID).alias("scores")
    ).first()
    borders = [about["scores"][min(GRID - 1, int(share * GRID))] for share in band_shares(about["rows"], n * about["groups"])]
    borders = sorted(set(borders))
    band = F.lit(0)
    for border in borders:
        band = band + F.when(F.col("__badness") > F.lit(border), 1).otherwise(0)
    banded = kept.distinct().withColumn("__band", band)
    work.write(banded, "bands", ["__band"])
    banded = work.read("bands", banded.schema)
    ranks = Window.partitionBy(group).orderBy("__badness", *order)
    taken = full = None
    for b in range(len(borders) + 1):
        local = banded.where(F.col("__band") == b).drop("__band")
        if full is not None:
            local = local.join(full, group, "left_anti")
        picked = local.withColumn("__place", F.row_number().over(ranks)).where(F.col("__place") <= n).drop("__place")
        picked = work.write(picked, f"picked-{b}")
        taken = picked if taken is None else taken.unionByName(picked)
        if b < len(borders):
            full = work.write(taken.groupBy(group).agg(F.count(F.lit(1)).alias("have")).where(F.col("have") >= n).select(group), f"full-{b}")
            below = banded.where(F.col("__band") > b).select(group).distinct()  # a row a group and task is moved
            if below.join(full, group, "left_anti").isEmpty():
                break
    work.keep_only(*[f"picked-{b}" for b in range(len(borders) + 1)])
    # a group filled across a border has n rows or more of several bands here, in small number
    last = taken.withColumn("__place", F.row_number().over(ranks)).where(F.col("__place") <= n)
    return last.select(*columns)
