"""Entity scores: weights, conditional sums, calibration and dominance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions.scalars import DEFAULT_RELATION, DIRECTION_SIGN, ODR_WEIGHT, RELATION_WEIGHT, argmax_name, calibrate, code_root, entity_prefix, gated, keyword_hits, lookup, second_largest


def eligible(allocations: DataFrame) -> DataFrame:
    """Decided or proposed statements of real codes with their analytic weight (mass x commitment x strength)."""
    kept = allocations.where(F.col("odr").isin(*ODR_WEIGHT) & ~F.col("code").startswith("NONE"))
    weight = F.col("mass") * lookup("odr", ODR_WEIGHT, None) * F.col("strength")
    return kept.withColumns({"entity": entity_prefix("doc_id"), "odr_weight": lookup("odr", ODR_WEIGHT, None), "weight": weight, "is_privacy": F.col("direction") != "neutral"})


def with_hits(cells: DataFrame, lexicon: Mapping[str, Sequence[str]]) -> DataFrame:
    """Adds the keyword hits of each goal in the text (hits_<goal>): before the fan-out to variants, so every text is searched once."""
    return cells.withColumns({f"hits_{g}": keyword_hits("text", patterns) for g, patterns in lexicon.items()})


def entity_scores(rows: DataFrame, lexicon: Mapping[str, Sequence[str]], signals: Mapping[str, Mapping[str, float]], by: Sequence[str] = ("variant", "entity"), num_family: str = "PRIV", den_families: Sequence[str] = ("PRIV", "AML", "KYC", "TECH"), kept_prefix: str | None = None) -> DataFrame:
    """One aggregation per entity: mass, counts, family share, posture, state ratio and raw goal scores.

    Goal score: weighted mean of keyword hits in the representative text (of :func:`with_hits`, or searched here) plus the signal of the code's root.
    The posture divides weighted signs by plain mass, so it may leave -1..1. Undefined shares are
    null, an undefined state ratio and undefined goal scores are 0.
    """
    sign, relation = lookup("direction", DIRECTION_SIGN, 0.0), lookup("relation", RELATION_WEIGHT, DEFAULT_RELATION)
    state = F.col("is_privacy") & (F.col("relation") == "from_state")
    goals = list(lexicon)
    root = code_root("code", kept_prefix)
    hit = {g: (F.col(f"hits_{g}") if f"hits_{g}" in rows.columns else keyword_hits("text", lexicon[g])) + (lookup(root, signals_of, 0.0) if (signals_of := {c: w[g] for c, w in signals.items() if g in w}) else F.lit(0.0)) for g in goals}
    scored = rows.withColumns({f"hit_{g}": h for g, h in hit.items()})
    total = F.sum("weight")
    return scored.groupBy(*by).agg(
        F.sum("mass").alias("mass"),
        F.count(F.lit(1)).alias("contributions"),
        F.count_distinct("doc_id").alias("documents"),
        F.try_divide(F.sum(F.when(F.col("family") == num_family, F.col("mass")).otherwise(0.0)), F.nullif(F.sum(F.when(F.col("family").isin(*den_families), F.col("mass")).otherwise(0.0)), F.lit(0.0))).alias("family_share"),
        F.try_divide(F.sum(F.col("weight") * sign * relation), F.sum("mass")).alias("posture"),
        F.coalesce(F.try_divide(F.sum(F.when(state, F.col("weight") * sign)), F.sum(F.when(state, F.col("weight")))), F.lit(0.0)).alias("state_raw"),
        *[F.coalesce(F.try_divide(F.sum(F.col(f"hit_{g}") * F.col("weight")), total), F.lit(0.0)).alias(f"raw_{g}") for g in goals],
    )


def thresholds(values: DataFrame, columns: Sequence[str], tiny: float = 1e-6) -> DataFrame:
    """One row: the 5th, 50th and 95th percentile of each column, pushed apart where they coincide."""
    q = values.agg(*[F.percentile(c, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias(c) for c in columns])
    lo, mid, hi = (lambda c: F.col(c)[0]), (lambda c: F.col(c)[1]), (lambda c: F.col(c)[2])
    out = []
    for c in columns:
        out += [F.when(mid(c) <= lo(c), mid(c) - tiny).otherwise(lo(c)).alias(f"{c}_lo"), mid(c).alias(f"{c}_mid"), F.when(hi(c) <= mid(c), mid(c) + tiny).otherwise(hi(c)).alias(f"{c}_hi")]
    return q.select(*out)


def calibrated(scores: DataFrame, goals: Sequence[str], gated_goal: str, reference: Column) -> DataFrame:
    """Adds calibrated scores; thresholds come from the ``reference`` rows and reach all rows as one broadcast row."""
    columns = [*[f"raw_{g}" for g in goals], "state_raw"]
    row = F.broadcast(thresholds(scores.where(reference), columns))
    both = scores.join(row, F.lit(True))  # a single row: no pairs are formed
    cal = lambda c: calibrate(F.col(c), F.col(f"{c}_lo"), F.col(f"{c}_mid"), F.col(f"{c}_hi"))
    both = both.withColumns({f"score_{g}": cal(f"raw_{g}") for g in goals} | {"state_score": cal("state_raw")})
    both = both.withColumn(f"score_{gated_goal}_ungated", F.col(f"score_{gated_goal}")).withColumn(f"score_{gated_goal}", gated(F.col(f"score_{gated_goal}"), F.col("state_score")))
    return both.drop(*[f"{c}_{k}" for c in columns for k in ("lo", "mid", "hi")])


def dominant(scores: DataFrame, goals: Sequence[str], margin: float = 0.10) -> DataFrame:
    """Adds the goal with the greatest score (first wins ties), both greatest scores and whether they are close."""
    names = [f"score_{g}" for g in goals]
    top, second = F.greatest(*names), second_largest(names)
    centre = F.substring(argmax_name(names), len("score_") + 1, 200)
    return scores.withColumns({"dominant": centre, "dominant_score": top, "second_score": second, "narrow": (top - second) < margin})


def composition(scores: DataFrame, goals: Sequence[str]) -> DataFrame:
    """Entities per variant and dominant goal, one column per goal."""
    return scores.groupBy("variant").pivot("dominant", list(goals)).agg(F.count_distinct("entity")).na.fill(0)


def with_dimension(scores: DataFrame, dimension: DataFrame, key: str, composite: Sequence[str] = ()) -> DataFrame:
    """Left join to a dimension with unique keys; flags composite entities.

    The dimension is checked lazily by ``expectations.duplicates``; Spark broadcasts it only under its size threshold.
    """
    return scores.join(dimension, key, "left").withColumn("is_composite", F.col(key).isin(*composite) if composite else F.lit(False))
