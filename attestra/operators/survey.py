"""Design-based estimation and sampling."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions.scalars import Z95


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: mean over the pairs without a null; null if the weights add up to 0."""
    known = value.isNotNull() & weight.isNotNull()
    return F.try_divide(F.sum(F.when(known, value * weight)), F.sum(F.when(known, weight)))


def stratum_detail(rows: DataFrame, value: str, stratum: str, design: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by``, stratum, population, n, mean, variance of the strata that have rows; the variance of a single row is .25."""
    stage = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(stratum).alias("stratum")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("v"))
    return design.select("stratum", "population").join(stage, "stratum").select(*by, "stratum", "population", "n", "mean", F.coalesce("v", F.lit(0.25)).alias("variance"))


def stratified(rows: DataFrame, value: str, stratum: str, design: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by``, estimate, standard_error, low, high with finite-population correction; shares are of the whole design's population."""
    detail = stratum_detail(rows, value, stratum, design, by)
    total = design.agg(F.sum("population").cast("double").alias("all"))
    w = F.col("population") / F.col("all")
    out = detail.join(F.broadcast(total), F.lit(True)).groupBy(*by).agg(
        F.sum(w * F.col("mean")).alias("estimate"),
        F.sqrt(F.greatest(F.sum(w * w * (1 - F.col("n") / F.col("population")) * F.col("variance") / F.col("n")), F.lit(0.0))).alias("standard_error"),
    )
    return out.select("*", F.greatest(F.lit(0.0), F.col("estimate") - Z95 * F.col("standard_error")).alias("low"), F.least(F.lit(1.0), F.col("estimate") + Z95 * F.col("standard_error")).alias("high"))


def sample_size(population: int, margin: float = 0.05, z: float = Z95, p: float = 0.5) -> tuple[int, float]:
    """Size that reaches the margin with finite-population correction, and the margin it achieves."""
    n0 = z * z * p * (1 - p) / margin**2
    n = min(population, math.ceil(n0 / (1 + (n0 - 1) / population))) if population else 0
    achieved = z * math.sqrt(p * (1 - p) / n * (population - n) / (population - 1)) if n and population > 1 else 0.0
    return n, achieved


def hash_sample(rows: DataFrame, id_col: str, strata: list[str], rate: float, seed: str) -> DataFrame:
    """Per stratum the ceil(rate * size) rows (one at least) with the smallest SHA-256 of seed and id, with inclusion probability and weight.

    Whether a row is in is decided by the stratum's count of smaller digests; digests are cut
    in 4096 ranges first, so no stratum is sorted in one task.
    """
    digest = F.sha2(F.concat_ws("|", F.lit(seed), F.col(id_col).cast("string")), 256)
    keyed = rows.withColumn("_h", digest).withColumn("_b", F.substring("_h", 1, 3))
    per = keyed.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_n"))
    total = per.groupBy(*strata).agg(F.sum("_n").alias("size"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*strata).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in strata]
    starts = per.withColumn("_before", before).alias("s").join(total.alias("t"), same("s", "t")).select("s.*", "t.size", F.greatest(F.lit(1), F.ceil(F.col("t.size") * rate)).cast("long").alias("want")).where("_before < want")
    place = F.row_number().over(Window.partitionBy(*[F.col(f"k.{c}") for c in strata], F.col("k._b")).orderBy("k._h", f"k.{id_col}"))
    joined = keyed.alias("k").join(starts.alias("s"), [*same("k", "s"), F.col("k._b") == F.col("s._b")])
    chosen = joined.select("k.*", "s.size", "s.want", "s._before", place.alias("_p")).where("_before + _p <= want")
    return chosen.select(*rows.columns, F.col("size").alias("stratum_size"), F.col("want").alias("stratum_sample"), (F.col("want") / F.col("size")).alias("inclusion_probability"), (F.col("size") / F.col("want")).alias("weight"))
