"""Pairs of rows from groups of rows, without one task per group.

A group of more than CHUNK rows is cut in blocks by a hash of the id, and blocks meet blocks:
a task never pairs more than CHUNK rows with CHUNK rows, however large a group is. Sizes are
counted once (:func:`sizes`); the groups that are cut are at most a CHUNK-th of the rows in number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 5_000


def sizes(members: DataFrame, key: list[str]) -> DataFrame:
    """Key columns and the number n of rows of each group."""
    return members.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))


def _blocks(counted: DataFrame, key: list[str]) -> DataFrame:
    return counted.where(F.col("n") > CHUNK).select(*key, F.ceil(F.col("n") / CHUNK).cast("int").alias("_blocks"))


def _count() -> Column:
    return F.coalesce("_blocks", F.lit(1))


def _block() -> Column:
    return F.pmod(F.xxhash64("id"), _count()).cast("int")


def within(members: DataFrame, counted: DataFrame, key: list[str]) -> DataFrame:
    """a < b: the unordered pairs of different ids of one group, at least once. ``members``: key columns and id; ``counted``: their sizes."""
    several = members.select(*key, "id").join(counted.where("n > 1").select(*key), key, "left_semi")
    m = several.join(_blocks(counted, key), key, "left").withColumn("_i", _block())
    left = m.select(*key, "_i", F.explode(F.sequence(F.col("_i"), _count() - 1)).alias("_j"), F.col("id").alias("_x"))
    right = m.select(*key, F.explode(F.sequence(F.lit(0), F.col("_i"))).alias("_h"), "_i", F.col("id").alias("_y")).withColumnsRenamed({"_i": "_j", "_h": "_i"})
    met = left.join(right, [*key, "_i", "_j"]).where("(_i < _j and _x <> _y) or _x < _y")
    return met.select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"))


def between(groups: DataFrame, members: DataFrame, counted: DataFrame, left: list[str], right: list[str], key: list[str], keep: list[str] | None = None) -> DataFrame:
    """a < b and the columns to ``keep``: the pairs of a member of the left and a member of the right group of each row of ``groups``.

    ``members``: key columns and id; ``counted``: their sizes; ``left`` and ``right`` name the columns of ``groups`` that hold the keys.
    """
    hot = _blocks(counted, key)
    m = members.select(*key, "id").join(hot, key, "left").withColumn("_block", _block()).select(*key, "_block", "id")
    out = groups
    for side, cols in (("_x", left), ("_y", right)):
        renamed = dict(zip(key, cols))
        out = out.join(hot.withColumnsRenamed(renamed), cols, "left").withColumn("_block", F.explode(F.sequence(F.lit(0), _count() - 1))).drop("_blocks")
        out = out.join(m.withColumnsRenamed(renamed | {"id": side}), [*cols, "_block"]).drop("_block")
    return out.where("_x <> _y").select(*(keep or []), F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"))
