"""Rows of each group in order of a random key, up to a budget, without sorting a whole group.

The key space is cut in equal buckets. Bucket sums are pre-aggregated; a group's
budget falls into one bucket; buckets before it are taken whole and only that one is
sorted. A group of a third of all rows thus sorts a 4096th of itself in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_BITS = 12


def up_to_budget(rows: DataFrame, budgets: DataFrame, group: list[str], key: str, tie: str, size: str, edge: str | None = None) -> DataFrame:
    """``rows`` whose running ``size`` in order of (``key``, ``tie``) stays within the group's ``budget``.

    ``rows`` must be cheap to scan twice. ``key`` is a long hash, ``size`` a non-null
    whole number, ``budgets`` has one row per group (a bounded table: strata or leaves),
    groups without a budget or with a null one give nothing. With ``edge`` the first row beyond a
    group's budget comes out as well, marked true in a column of that name.
    """
    bucket = F.shiftrightunsigned(F.col(key), 64 - BUCKET_BITS)
    sums = rows.withColumn("_bucket", bucket).groupBy(*group, "_bucket").agg(F.sum(size).alias("_sum"))
    running = F.sum("_sum").over(Window.partitionBy(*group).orderBy("_bucket"))
    over = sums.withColumn("_end", running).join(budgets, group).where("_end > budget")
    over = over.groupBy(*group).agg(F.min(F.struct("_bucket", (F.col("budget") - F.col("_end") + F.col("_sum")).alias("_rest"))).alias("_e"))
    some = budgets if edge else budgets.where("budget > 0")
    limits = some.where("budget is not null").join(over, group, "left").select(*group, F.col("_e._bucket").alias("_edge"), F.col("_e._rest").alias("_rest"))
    near = rows.withColumn("_bucket", bucket).join(limits, group).where("_edge is null or _bucket <= _edge")
    whole = near.where("_edge is null or _bucket < _edge")
    last = near.where("_bucket = _edge")
    so_far = F.sum(size).over(Window.partitionBy(*group).orderBy(key, tie).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = last.withColumn("_so_far", so_far)
    if edge:
        last = last.where(F.col("_so_far") - F.col(size) <= F.col("_rest")).withColumn(edge, F.col("_so_far") > F.col("_rest"))
        whole = whole.withColumn(edge, F.lit(False))
    else:
        last = last.where("_so_far <= _rest")
    return whole.unionByName(last.drop("_so_far")).drop("_bucket", "_edge", "_rest")
