"""Declarative checks of tables and of manifests; every check is a DataFrame that is empty when it holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def missing_keys(rows: DataFrame, dimension: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of ``rows`` that the dimension lacks (null keys are missing)."""
    return rows.select(*keys).distinct().join(dimension.select(*keys), list(keys), "left_anti")


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, n of rows that break each rule in one pass; a null condition breaks it; rules without a breach are listed with 0."""
    broken = rows.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(name) for name, c in rules.items()])
    return broken.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in rules])).alias("x")).select("x.*")


def set_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys on one side only, and which."""
    l = left.select(*keys).distinct().withColumn("_l", F.lit(True))
    r = right.select(*keys).distinct().withColumn("_r", F.lit(True))
    return l.join(r, list(keys), "full").where("_l is null or _r is null").select(*keys, F.when(F.col("_r").isNull(), "left").otherwise("right").alias("only_in"))


def manifest_diff(old: DataFrame, new: DataFrame, path: str, digest: str) -> DataFrame:
    """path, status: added, removed or changed."""
    a = old.select(F.col(path).alias("path"), F.col(digest).alias("a"))
    b = new.select(F.col(path).alias("path"), F.col(digest).alias("b"))
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
    return a.join(b, "path", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("path", status.alias("status"))
