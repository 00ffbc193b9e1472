"""Plan inspection, for tests and for looking at what Catalyst made of a query."""

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def physical_plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def operators(df: DataFrame) -> set[str]:
    """Names of the physical operators of a plan."""
    return set(re.findall(r"\b([A-Z]\w+(?:Join|Exchange|Aggregate|Scan|Filter|Sort|Window|Project|Generate|Exec|Pandas|Arrow)\w*)\b", physical_plan(df)))


def search_report(found: DataFrame, targets: DataFrame | list[int], distance: int) -> DataFrame:
    """(strategy, targets, distance, results) of a batch search, which is run. strategy names the join that was planned."""
    n = len(targets) if isinstance(targets, list) else targets.count()
    plan = physical_plan(found)
    strategy = "scan" if "NestedLoop" in plan else "pivot" if "__from" in plan else "bands" if "__band" in plan else "equality"
    results = found.agg(F.count(F.lit(1)).alias("results"))
    return results.select(F.lit(strategy).alias("strategy"), F.lit(n).cast("bigint").alias("targets"), F.lit(distance).cast("bigint").alias("distance"), "results")
