"""Problem 6: a sample with given shares of every category.

Method: count categories, allocate whole quotas by largest remainder with minimum
floors and availability caps, select the smallest random keys of each category, report
shortfalls. The allocation has a closed form: the quotas before rounding are the shares
times one factor, kept between floor and cap; the factor at which they add up to the total
lies between two of the points where a category leaves its floor or meets its cap, which
sorting those points finds. All of it runs over the table of categories, of any length; counting
and selecting are distributed and never sort a whole category.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.llm.prefix import up_to_budget
from attestra.tables import materialize


def allocate(strata: DataFrame, order: list[str], total: int | Column, floor: int = 1, redistribute: bool = True) -> DataFrame:
    """Adds ``quota`` to categories with ``share`` and ``available``.

    At least ``floor`` where rows exist, never more than available. Remainders go to the largest
    fractions, ties to the earlier category by ``order``. With ``redistribute`` quotas add up to ``total`` as far as
    floors and caps allow, and what one category cannot use or a floor takes goes by share; without it every
    category stands alone. Null and negative shares count as 0 and get their floor; null ``available`` is 0.
    """
    everyone = Window.partitionBy(F.lit(0))
    d = strata.withColumns({"_s": F.greatest(F.lit(0.0), F.coalesce(F.col("share").cast("double"), F.lit(0.0))), "_c": F.coalesce("available", F.lit(0)).cast("double"), "_t": (F.lit(total) if isinstance(total, int) else total).cast("double")})
    d = d.withColumn("_f", F.least(F.lit(float(floor)), F.col("_c")))
    plain = F.coalesce(F.try_divide(F.col("_t"), F.sum("_s").over(everyone)), F.lit(0.0))
    if redistribute:
        points = F.explode(F.array(F.struct((F.col("_f") / F.col("_s")).alias("at"), F.col("_s").alias("slope")), F.struct((F.col("_c") / F.col("_s")).alias("at"), (-F.col("_s")).alias("slope")))).alias("p")
        floors = d.agg(F.sum("_f").alias("base"), F.max("_t").alias("t"))
        p = d.where("_s > 0").select(points).groupBy("p.at").agg(F.sum("p.slope").alias("slope"))
        in_order = Window.partitionBy(F.lit(0)).orderBy("at")
        p = p.withColumn("slope", F.sum("slope").over(in_order)).withColumn("next", F.lead("at").over(in_order))
        # the sum of all quotas at each point
        grown = F.coalesce(F.sum(F.col("slope") * (F.coalesce("next", F.col("at")) - F.col("at"))).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        p = p.withColumn("grown", grown).join(floors, F.lit(True)).where(F.col("base") + F.col("grown") <= F.col("t") + 1e-9)
        here = F.col("at") + F.when(F.col("slope") > 1e-12, (F.col("t") - F.col("base") - F.col("grown")) / F.col("slope")).otherwise(0.0)
        factor = p.agg(F.coalesce(F.max_by(here, "at"), F.lit(0.0)).alias("_factor"))  # one row
        d = d.join(factor, F.lit(True))
    else:
        d = d.withColumn("_factor", plain)
    d = d.withColumn("_x", F.greatest(F.col("_f"), F.least(F.col("_c"), F.col("_factor") * F.col("_s"))))
    d = d.withColumn("_q", F.floor(F.col("_x") + 1e-6).cast("long"))
    left = F.round(F.sum("_x").over(everyone)) - F.sum("_q").over(everyone)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round(F.col("_x") - F.col("_q"), 9)), *order))
    more = ((place <= left) & (F.col("_q") < F.col("_c"))).cast("long")
    return d.withColumn("quota", F.col("_q") + more).drop("_s", "_c", "_t", "_f", "_factor", "_x", "_q")


def _clean(c: Column) -> Column:
    return F.lower(F.trim(c))


class QuotaSample:
    """Sample of ``rows`` by the strata of ``targets``.

    ``strata`` names the category columns of both (read without regard to case and outer blanks; a null in
    one belongs to no stratum), ``want`` a target count or, with ``total``, a target share, and ``id_col`` what is
    counted once per stratum. Targets that are null count as 0; repeated strata of the target table are added up.
    Without a ``total`` each stratum gets its target as far as it goes; with one, quotas add up to it and what a
    stratum lacks goes to the others by share. Empty tables give an empty sample and a report of zeros.
    """

    def __init__(self, rows: DataFrame, targets: DataFrame, strata: list[str], want: str, id_col: str, seed: int = 1, total: Column | None = None, floor: int = 1):
        self.strata, self.id_col, self.seed, self.free = strata, id_col, seed, total is not None
        clean = rows.select(F.col(id_col).alias("_id"), *[_clean(F.col(c)).alias(c) for c in strata]).na.drop()
        self.items = materialize(clean.distinct(), "strata")
        counts = self.items.groupBy(*strata).agg(F.count(F.lit(1)).alias("available"))
        number = F.coalesce(F.col(want).cast("double"), F.lit(0.0)) if self.free else F.coalesce(F.col(want), F.lit(0)).cast("long")
        wanted = targets.select(*[F.col(c).alias(f"_{c}") for c in strata], *[_clean(F.col(c)).alias(c) for c in strata], number.alias("target"), (total if self.free else F.lit(None).cast("long")).alias("_total"))
        wanted = wanted.na.drop(subset=strata).groupBy(*strata).agg(F.sum("target").alias("target"), F.sum("_total").alias("_total"), *[F.min(f"_{c}").alias(f"_{c}") for c in strata])
        table = wanted.join(counts, strata, "left").withColumns({"available": F.coalesce("available", F.lit(0)), "share": F.col("target")})
        everyone = Window.partitionBy(F.lit(0))
        table = table.withColumn("total", F.sum("_total" if self.free else F.greatest(F.col("target"), F.lit(0))).over(everyone)).drop("_total")
        self.quotas = materialize(allocate(table, strata, F.col("total"), floor, redistribute=self.free), "quotas")

    def report(self) -> DataFrame:
        """One row per stratum of the targets: target, available, quota and shortfall; with a total: target share, share of the sample, and what the stratum lacks of its part."""
        names = [F.col(f"_{c}").alias(c) for c in self.strata]
        if not self.free:
            return self.quotas.select(*names, "target", "available", "quota", F.greatest(F.col("target") - F.col("quota"), F.lit(0)).alias("shortfall"))
        part = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.sum(c).over(Window.partitionBy(F.lit(0)))), F.lit(0.0))
        d = self.quotas.withColumns({"target_share": part("share"), "actual_share": part("quota")})
        return d.select(*names, "target_share", "available", "quota", "actual_share", F.greatest(F.floor(F.col("target_share") * F.col("total") + 1e-6) - F.col("quota"), F.lit(0)).cast("long").alias("shortfall"))

    def sample(self) -> DataFrame:
        """The chosen ids with their stratum."""
        keyed = self.items.withColumn("_key", F.xxhash64(F.lit(self.seed), F.col("_id").cast("string"))).withColumn("_one", F.lit(1).cast("long"))
        budgets = self.quotas.select(*self.strata, F.col("quota").alias("budget"))
        return up_to_budget(keyed, budgets, self.strata, "_key", "_id", "_one").select(F.col("_id").alias(self.id_col), *self.strata)
