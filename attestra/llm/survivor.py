"""Problem 3: the best value of each field of a group of duplicate records.

Method: skyline selection. Per field, records are compared by completeness (the field
holds a usable value), recency and trust; Pareto-undominated records form the first
layer, a lexicographic policy (trust, then recency, then the smaller id) resolves it,
and a field the first layer leaves empty is filled from the layers that follow.

Scale: a record can only survive if it is the latest of its cell, a cell being
(group, usable fields, trust); every group is reduced to those cells by a
pre-aggregated arg-max first, so skylines run over at most 2 * 2**fields records
whatever the size of the group. Values cut short are found by a range sort of distinct values,
which splits hot groups, never by comparing all pairs of a group.

What p3_found asks for (the best usable value of each field) always lies in a field's first layer; the
record built by :func:`built_records`, whose completeness counts all fields, is filled from later ones.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.llm.canon import canonical, is_placeholder
from attestra.tables import materialize

def cut_short(values: DataFrame) -> DataFrame:
    """Of ``values`` (g, field, v; distinct) those that another value of the same group and field starts with and continues.

    In sorted order a continuation stands right behind. The values are range-partitioned by group,
    field and value, which cuts a large group at values rather than keeping it in one task; the last
    value of a partition is compared with the first of the next. Empty values are never cut.
    """
    kept = values.where(F.length("v") > 0).select("g", "field", "v")
    placed = materialize(kept.repartitionByRange("g", "field", "v").withColumn("part", F.spark_partition_id()), "sorted")
    here = F.struct("g", "field", "v")
    first = placed.groupBy("part").agg(F.min(here).alias("first"))  # a row for each partition
    behind = first.select("part", F.lead("first").over(Window.orderBy("part")).alias("behind"))
    following = F.lead(here).over(Window.partitionBy("part").orderBy("g", "field", "v"))
    both = placed.withColumn("following", following).join(behind, "part").withColumn("n", F.coalesce("following", "behind"))
    return both.where("n.g = g and n.field = field and startswith(n.v, v)").select("g", "field", "v")


def dominance_layers(cells: Column, axes: tuple[str, ...] = ("usable", "at", "trust")) -> Column:
    """Adds to each cell (struct that begins with the axes, in any order) its layer: 0 if nothing dominates it, else one more than the last that does."""

    def beats(a: Column, b: Column) -> Column:
        return reduce(and_, [a[x] >= b[x] for x in axes]) & reduce(or_, [a[x] > b[x] for x in axes])

    # the layer of a record is the longest chain of records that dominate it; in lexicographic order
    # whoever dominates comes first, so one pass with the layers so far gives it
    ordered = F.sort_array(cells, asc=False)
    start = F.slice(F.transform(ordered, lambda c: F.struct(c.alias("c"), F.lit(0).alias("layer"))), 1, 0)

    def step(done: Column, c: Column) -> Column:
        above = F.filter(done, lambda d: beats(d["c"], c))
        layer = F.coalesce(F.array_max(F.transform(above, lambda d: d["layer"])) + 1, F.lit(0))
        return F.array_append(done, F.struct(c.alias("c"), layer.alias("layer")))

    return F.aggregate(ordered, start, step)


def _cells(records: DataFrame, group: str, record: str, received: str, fields: dict[str, Column], trust: Column) -> DataFrame:
    """g, cells: of each group the latest record of every (usable fields, trust): flags, trust, key."""
    flags = F.array(*[F.coalesce(fields[f], F.lit(False)).cast("int") for f in fields])
    base = records.where(F.col(group).isNotNull()).select(
        F.col(group).alias("g"), flags.alias("flags"), F.coalesce(trust, F.lit(False)).cast("int").alias("trust"),
        F.struct(F.coalesce(F.col(received).cast("timestamp_ntz"), F.lit("0001-01-01").cast("timestamp_ntz")).alias("at"), (-F.col(record)).alias("minus")).alias("key"),
    )
    latest = base.groupBy("g", "flags", "trust").agg(F.max("key").alias("key"))
    return latest.groupBy("g").agg(F.collect_list(F.struct("flags", "trust", "key")).alias("cells"))  # at most 2 ** (fields + 1)


def best_values(records: DataFrame, group: str, record: str, received: str, fields: dict[str, Column], trust: Column) -> DataFrame:
    """``group``, field_name, ``record``, layer: for every group and field with a usable value the record it is kept from.

    ``fields`` maps a field to the condition that its value is usable. A null time
    counts as the earliest, ties go to the smaller record, null conditions and null trust
    count as false. Groups of one record are answered as well; groups with a null key are left out.
    """
    names = list(fields)
    cells = _cells(records, group, record, received, fields, trust)
    per_field = cells.select("g", F.posexplode(F.array(*map(F.lit, names))).alias("i", "field_name"), "cells").select(
        "g",
        "field_name",
        F.expr("transform(cells, c -> struct(c.flags[i] as usable, c.trust as trust, c.key.at as at, c.key.minus as minus))").alias("cells"),
    )
    layered = per_field.select("g", "field_name", dominance_layers(F.col("cells")).alias("cells"))
    # the first layer with a usable value fills the field; within it trust, then recency, then the smaller record decide
    usable = F.filter("cells", lambda d: d["c"]["usable"] == 1)
    first = F.array_min(F.transform(usable, lambda d: d["layer"]))
    kept = layered.select("g", "field_name", usable.alias("usable"), first.alias("layer")).where("layer is not null")
    front = F.expr("filter(usable, d -> d.layer = layer)")
    best = F.array_max(F.transform(front, lambda d: F.struct(d["c"]["trust"].alias("trust"), d["c"]["at"].alias("at"), d["c"]["minus"].alias("minus"))))
    return kept.select(F.col("g").alias(group), "field_name", (-best["minus"]).alias(record), "layer")


def built_records(records: DataFrame, group: str, record: str, received: str, fields: dict[str, Column], trust: Column) -> DataFrame:
    """``group``, base, field_name, ``record``, layer: one surviving record for every group, and where each of its fields is kept from.

    Layers are those of whole records over completeness (usable fields), recency and trust, of the latest
    record of every (usable fields, trust). The base is the record of the first layer that trust, recency, completeness
    and the smaller id put first; a field it has no usable value for is filled from the first layer that has one
    (``layer``), within it by the same order; fields no record has are null. Conditions as in ``best_values``.
    """
    names = list(fields)
    cells = _cells(records, group, record, received, fields, trust)
    whole = F.expr("transform(cells, c -> struct(aggregate(c.flags, 0, (x, y) -> x + y) as complete, c.key.at as at, c.trust as trust, c.key.minus as minus, c.flags as flags))")
    layered = cells.select("g", dominance_layers(whole, ("complete", "at", "trust")).alias("cells"))
    policy = lambda d: F.struct((-d["layer"]).alias("first"), d["c"]["trust"].alias("trust"), d["c"]["at"].alias("at"), d["c"]["complete"].alias("complete"), d["c"]["minus"].alias("minus"), d["c"]["flags"].alias("flags"))
    best = layered.select("g", F.array_max(F.transform("cells", policy)).alias("base"), F.transform("cells", policy).alias("cells"))
    rows = best.select("g", "base", "cells", F.posexplode(F.array(*map(F.lit, names))).alias("i", "field_name"))
    own = F.expr("base.flags[i] = 1")
    other = F.expr("array_max(filter(cells, c -> c.flags[i] = 1))")
    rows = rows.select("g", "base", "field_name", F.when(own, F.col("base")).otherwise(other).alias("x"))
    return rows.select(F.col("g").alias(group), (-F.col("base.minus")).alias("base"), "field_name", (-F.col("x.minus")).alias(record), (-F.col("x.first")).alias("layer"))


def _statements(outputs: DataFrame, codebook: DataFrame) -> tuple[DataFrame, dict[str, Column], Column]:
    """Rows of statements delivered more than once, which of their fields are usable, and which rows are trusted."""
    cols = ["record_id", "statement_id", "quote", "quote_en", "code1", "qc_status", "received_at"]
    several = outputs.where("statement_id is not null").groupBy("statement_id").count().where("count > 1").select("statement_id")
    rows = outputs.select(*cols).join(several, "statement_id", "left_semi")
    form = lambda c: F.when(~is_placeholder(F.col(c)), canonical(F.col(c)))
    rows = rows.withColumns({"f_quote": form("quote"), "f_quote_en": form("quote_en")}).drop("quote", "quote_en")
    rows = materialize(rows, "statements")
    texts = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"f_{f}").alias("v")) for f in ("quote", "quote_en")])).alias("t")
    values = rows.select(F.col("statement_id").alias("g"), texts).select("g", "t.*").where("v is not null").distinct()
    cut = cut_short(values)
    for f in ("quote", "quote_en"):
        own = cut.where(F.col("field") == f).select(F.col("g").alias("statement_id"), F.col("v").alias(f"f_{f}"), F.lit(True).alias(f"cut_{f}"))
        rows = rows.join(own, ["statement_id", f"f_{f}"], "left")
    codes = codebook.select(F.col("code").alias("code1")).where("code1 is not null").distinct().withColumn("known", F.lit(True))
    rows = rows.join(codes, "code1", "left")
    usable = {f: F.col(f"f_{f}").isNotNull() & F.col(f"cut_{f}").isNull() for f in ("quote", "quote_en")} | {"code1": F.col("known")}
    trusted = F.coalesce(F.lower(F.trim("qc_status")) != "fail", F.lit(True))
    return rows, usable, trusted


def statement_survivors(outputs: DataFrame, codebook: DataFrame) -> DataFrame:
    """statement_id, field_name, record_id for statements delivered more than once (null statement ids belong to no group)."""
    rows, usable, trusted = _statements(outputs, codebook)
    return best_values(rows, "statement_id", "record_id", "received_at", usable, trusted).select("statement_id", "field_name", "record_id")


def statement_records(outputs: DataFrame, codebook: DataFrame) -> DataFrame:
    """statement_id, record_id, quote, quote_en, code1, last_layer: the built record of statements delivered more than once and the deepest layer a field came from."""
    rows, usable, trusted = _statements(outputs, codebook)
    kept = built_records(rows, "statement_id", "record_id", "received_at", usable, trusted)
    values = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in usable])).alias("v")
    given = outputs.select("record_id", values).select("record_id", "v.*")
    full = kept.join(given, ["record_id", "field_name"], "left")
    return full.groupBy("statement_id", F.col("base").alias("record_id")).agg(*[F.max(F.when(F.col("field_name") == f, F.col("value"))).alias(f) for f in usable], F.max("layer").alias("last_layer"))
