"""Agreement of two raters on nominal labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def two_raters(rows: DataFrame, left: str, right: str, weight: str | None = None, drop_empty: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """One row for each group of ``by``: n, missing, agree, agreement, weighted_agreement, alpha (Krippendorff), ac1 (Gwet).

    Pairs with a null (and with ``drop_empty`` an empty) label are missing. alpha and ac1 are null where
    chance agreement leaves no room (a single category) or no pair is left. Category counts come
    from one pre-aggregated contingency table.
    """
    l, r = F.col(left).cast("string"), F.col(right).cast("string")
    known = l.isNotNull() & r.isNotNull() & (((l != "") & (r != "")) if drop_empty else F.lit(True))
    w = F.col(weight) if weight else F.lit(1.0)
    cells = rows.select(*by, F.coalesce(known, F.lit(False)).alias("known"), l.alias("l"), r.alias("r"), w.cast("double").alias("w"))
    table = cells.groupBy(*by, "known", F.when(F.col("known"), F.col("l")).alias("l"), F.when(F.col("known"), F.col("r")).alias("r")).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))
    same = F.col("known") & (F.col("l") == F.col("r"))
    totals = table.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(F.col("known"), F.col("n"))), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(~F.col("known"), F.col("n"))), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(F.when(same, F.col("n"))), F.lit(0)).alias("agree"), F.sum(F.when(same, F.col("w"))).alias("ws"), F.sum(F.when(F.col("known"), F.col("w"))).alias("wn"),
    )
    sides = table.where("known").select(F.explode(F.array("l", "r")).alias("label"), "n", *by).groupBy(*by, "label").agg(F.sum("n").alias("c"))
    marg = sides.groupBy(*by).agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("c").cast("double") * (F.col("c") - 1)).alias("cc"), F.sum(F.col("c").cast("double") * F.col("c")).alias("c2"))
    both = totals.join(marg, list(by), "left") if by else totals.join(F.broadcast(marg), F.lit(True))  # one row for each group
    n2 = 2.0 * F.col("n")
    p = F.try_divide(F.col("agree").cast("double"), F.col("n"))
    expected_unlike = 1 - F.try_divide(F.col("cc"), n2 * (n2 - 1))
    chance = F.try_divide(1 - F.try_divide(F.col("c2"), n2 * n2), (F.col("k") - 1).cast("double"))
    return both.select(
        *by, "n", "missing", "agree", p.alias("agreement"), F.try_divide(F.coalesce("ws", F.when(F.col("n") > 0, 0.0)), F.col("wn")).alias("weighted_agreement"),
        (1 - F.try_divide(1 - p, expected_unlike)).alias("alpha"), F.try_divide(p - chance, 1 - chance).alias("ac1"),
    )
