"""Fractional allocation of each candidate's unit of mass, and what is counted from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions.scalars import annotation, family, first_text


def contributions(evidence: DataFrame) -> DataFrame:
    """One row per (candidate, provider, code, annotation) with that part of the provider's mass.

    A provider's mass is divided by its distinct codes and each code's by its distinct
    annotations. ``evidence``: candidate_id, provider, code, odr, privacy_direction, privacy_relation,
    strength, quote, quote_en, statement_id; rows without candidate, provider or code are left out.
    The representative statement is the longest text, then the greatest SHA-256 of it, then the smallest id.
    Cell counts come from aggregates of the distinct cells, never from a window over raw evidence.
    """
    clean = evidence.na.drop(subset=["candidate_id", "provider", "code"]).withColumn("a", annotation())
    text = first_text("quote_en", "quote")
    rank = F.struct(F.char_length(text).alias("n"), F.sha2(text, 256).alias("h"))
    best = F.max_by(F.struct("statement_id", text.alias("text")), F.struct(rank.alias("r"), F.lit(0).alias("z")))
    cells = clean.groupBy("candidate_id", "provider", "code", "a").agg(best.alias("b"))
    by = Window.partitionBy("candidate_id", "provider")
    in_code = F.count(F.lit(1)).over(Window.partitionBy("candidate_id", "provider", "code"))
    codes = F.size(F.collect_set("code").over(by))
    part = (F.lit(1.0) / codes / in_code).alias("part")
    return cells.select("candidate_id", "provider", "code", family("code").alias("family"), "a.*", F.col("b.statement_id").alias("statement_id"), F.col("b.text").alias("text"), part)


def variants(cells: DataFrame, providers: Sequence[str]) -> DataFrame:
    """Fans the cells out to the variants: ensemble, one per provider, and consensus where all providers have equal code sets."""
    per = cells.groupBy("candidate_id", "provider").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    sides = per.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("present"), F.count_distinct("codes").alias("kinds"))
    shared = cells.join(sides, "candidate_id")
    consensus = (F.col("present") == len(providers)) & (F.col("kinds") == 1)
    fan = F.array(
        F.struct(F.lit("ensemble").alias("variant"), (1.0 / F.col("present")).alias("share")),
        F.struct(F.col("provider").alias("variant"), F.lit(1.0).alias("share")),
        F.struct(F.when(consensus, F.lit("consensus")).alias("variant"), F.lit(1.0 / len(providers)).alias("share")),
    )
    out = shared.withColumn("v", F.explode(fan)).where("v.variant is not null")
    return out.withColumn("variant", F.col("v.variant")).withColumn("mass", F.col("part") * F.col("v.share")).drop("v", "part", "present", "kinds")


def mass_check(allocations: DataFrame, eps: float = 1e-9) -> DataFrame:
    """(variant, candidate_id, mass) whose mass is not 1: empty when the allocation is right."""
    return allocations.groupBy("variant", "candidate_id").agg(F.sum("mass").alias("mass")).where(F.abs(F.col("mass") - 1) > eps)


def set_agreement(evidence: DataFrame, left: str, right: str, columns: dict[str, Column]) -> DataFrame:
    """How often two providers' sets agree over the candidates both have: measure, shared, agree, rate."""
    sets = evidence.groupBy("candidate_id", "provider").agg(*[F.array_sort(F.collect_set(c)).alias(m) for m, c in columns.items()])
    side = lambda p: F.max(F.when(F.col("provider") == p, F.struct(*columns)))
    both = sets.groupBy("candidate_id").agg(side(left).alias("l"), side(right).alias("r")).where("l is not null and r is not null")
    measures = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), (F.col(f"l.{m}") == F.col(f"r.{m}")).alias("same")) for m in columns])).alias("x")
    out = both.select(measures).groupBy("x.measure").agg(F.count(F.lit(1)).alias("shared"), F.count_if("x.same").alias("agree"))
    return out.withColumn("rate", F.try_divide(F.col("agree").cast("double"), F.col("shared")))


def distributions(allocations: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """variant, dimension, category, mass, share of the variant's mass in that dimension; null categories count as '' ."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("")).alias("category")) for d in dimensions])).alias("x")
    mass = allocations.select("variant", "mass", pairs).groupBy("variant", "x.dimension", "x.category").agg(F.sum("mass").alias("mass"))
    total = F.sum("mass").over(Window.partitionBy("variant", "dimension"))
    return mass.withColumn("share", F.try_divide(F.col("mass"), total)).orderBy("dimension", "variant", F.desc("mass"), "category")
