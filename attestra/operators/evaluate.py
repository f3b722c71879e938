"""Predictions against a reference: confusion, per-class measures, gates, fidelity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions.scalars import f1, normalize_span

# Thresholds of the acceptance gates.
GATES = {"recall": 0.90, "recall_low": 0.85, "stress_recall": 0.85, "stress_positives": 15, "precision": 0.80, "workload": 3.0, "code_recall": 0.80, "coded": 15, "fidelity": 0.95}


def counts(truth: Column, predicted: Column) -> list[Column]:
    """tp, fp, fn, tn; excluded and null truths count nowhere, a null prediction is negative."""
    p = F.coalesce(predicted, F.lit(False))
    pos, neg = truth == "positive", truth == "negative"
    return [F.count_if(pos & p).alias("tp"), F.count_if(neg & p).alias("fp"), F.count_if(pos & ~p).alias("fn"), F.count_if(neg & ~p).alias("tn")]


def with_rates(df: DataFrame) -> DataFrame:
    """Adds precision, recall (null where undefined) and f1 (0 where undefined)."""
    d = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(a) + F.col(b))
    return df.withColumns({"precision": d("tp", "fp"), "recall": d("tp", "fn")}).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def confusion(rows: DataFrame, predicted: str, truth: str = "truth", by: Sequence[str] = ()) -> DataFrame:
    return with_rates(rows.groupBy(*by).agg(*counts(F.col(truth), F.col(predicted))))


def confusion_rollup(rows: DataFrame, predicted: str, by: str, truth: str = "truth") -> DataFrame:
    """Each stratum and their total in one pass (the total has a null stratum)."""
    return with_rates(rows.where(F.col(by).isNotNull()).rollup(by).agg(*counts(F.col(truth), F.col(predicted))))


def page_confusion(rows: DataFrame, predicted: str, page: Sequence[str], truth: str = "truth") -> DataFrame:
    """Confusion of pages: positive if any counted paragraph is, predicted if any counted paragraph is."""
    counted = rows.where(F.col(truth).isin("positive", "negative"))
    pages = counted.groupBy(*page).agg(F.bool_or(F.col(truth) == "positive").alias("t"), F.bool_or(F.coalesce(F.col(predicted), F.lit(False))).alias("p"))
    return with_rates(pages.agg(*counts(F.when(F.col("t"), "positive").otherwise("negative"), F.col("p"))))


def per_class(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """label, support, predicted, tp, precision, recall, f1 (0 where undefined) over the union of labels; null labels are no label."""
    pairs = F.explode(F.array(F.struct(F.col(truth).alias("label"), F.lit(1).alias("s"), F.lit(0).alias("p")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("s"), F.lit(1).alias("p")))).alias("x")
    same = F.col(truth) == F.col(predicted)
    out = rows.select(pairs, same.alias("same")).where("x.label is not null").groupBy("x.label").agg(F.sum("x.s").alias("support"), F.sum("x.p").alias("predicted"), F.sum(F.when(F.col("same"), F.col("x.s")).otherwise(0)).alias("tp"))
    zero = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    out = out.withColumns({"precision": zero("tp", "predicted"), "recall": zero("tp", "support")})
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def macro(classes: DataFrame) -> DataFrame:
    """Macro averages, accuracy and how many classes are never predicted or never true."""
    return classes.agg(
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"),
        F.try_divide(F.sum("tp").cast("double"), F.sum("support")).alias("accuracy"), F.count_if((F.col("support") == 0) | (F.col("predicted") == 0)).alias("degenerate"),
    )


def cluster_totals(rows: DataFrame, predicted: str, cluster: str, truth: str = "truth") -> DataFrame:
    return rows.groupBy(cluster).agg(*counts(F.col(truth), F.col(predicted)))


def gates(measures: DataFrame) -> DataFrame:
    """Pass or fail from a row with recall, recall_low, stress_recall, stress_positives, precision, workload, code_recall, coded; undefined fails."""
    ok = lambda c: F.when(F.coalesce(c, F.lit(False)), "pass").otherwise("fail")
    at_least = lambda c: F.col(c) >= GATES[c]
    return measures.select(
        "*",
        ok(at_least("recall") & at_least("recall_low")).alias("e1"),
        ok(at_least("stress_positives") & at_least("stress_recall")).alias("e2"),
        ok(at_least("precision") & (F.col("workload") <= GATES["workload"])).alias("e3"),
        ok(at_least("coded") & at_least("code_recall")).alias("c1"),
    )


def alignment(records: DataFrame, truth: str = "truth", by: Sequence[str] = ()) -> DataFrame:
    """Assigned statements by truth, unassigned ones (null truth) and precision with those as false positives."""
    out = records.groupBy(*by).agg(*[F.count_if(F.col(truth) == t).alias(f"assigned_{t}") for t in ("positive", "negative", "excluded")], F.count_if(F.col(truth).isNull()).alias("unassigned"))
    return out.withColumn("conservative_precision", F.try_divide(F.col("assigned_positive").cast("double"), F.col("assigned_positive") + F.col("assigned_negative") + F.col("unassigned")))


def candidate_summary(rows: DataFrame, by: Sequence[str], methods: Mapping[str, Sequence[str]]) -> DataFrame:
    """on_pages, assigned, unassigned, assigned by truth, and counts of groups of methods; ``rows`` has method (null: unassigned) and truth."""
    assigned = F.col("method").isNotNull()
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("on_pages"), F.count_if(assigned).alias("assigned"), F.count_if(~assigned).alias("unassigned"),
        *[F.count_if(assigned & (F.col("truth") == t)).alias(f"assigned_{t}") for t in ("positive", "negative", "excluded")], *[F.count_if(F.col("method").isin(*m)).alias(n) for n, m in methods.items()],
    )


def span_fidelity(rows: DataFrame, quote: str, source: str, rendered: str) -> DataFrame:
    """supported, unsupported, render_review, fidelity and gate of quotes against their source."""
    q, s = normalize_span(quote), normalize_span(source)
    status = F.when((q != "") & F.contains(s, q), "supported").when(F.coalesce(F.col(rendered), F.lit(False)), "render").otherwise("unsupported")
    out = rows.select(status.alias("status")).agg(F.count_if(F.col("status") == "supported").alias("supported"), F.count_if(F.col("status") == "unsupported").alias("unsupported"), F.count_if(F.col("status") == "render").alias("render_review"))
    out = out.withColumn("fidelity", F.try_divide(F.col("supported").cast("double"), F.col("supported") + F.col("unsupported")))
    return out.withColumn("gate", F.when(F.col("render_review") > 0, "pending_render_review").when(F.col("fidelity") >= GATES["fidelity"], "pass").otherwise("fail"))


def coverage(rows: DataFrame, label: str, matched: str) -> DataFrame:
    """Matched and total rows by label."""
    out = rows.groupBy(label).agg(F.count_if(F.col(matched)).alias("matched"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("share", F.try_divide(F.col("matched").cast("double"), F.col("total")))
