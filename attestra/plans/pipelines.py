"""The three analyses from tables to exported results, and their verification."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.plans import catalogue
from attestra.sources import writers
from attestra.tables import discard, materialize, write_bytes

# Results of each analysis: name of the table and the query it comes from.
ENSEMBLE = {
    "distributions": "q_alloc_distribution", "agreement": "q_provider_agreement", "populations": "q_variant_population", "origins": "q_origin_counts", "entity_scores": "q_entity_scores",
    "calibrated": "q_entity_calibrated", "dominance": "q_dominant_centre", "composition": "q_composition_pivot", "correlations": "q_macro_corr", "inference": "q_exact_inference", "ranking": "q_rank_posture",
}
EVALUATION = {
    "confusion": "q_matched_confusion", "confusion_by_stratum": "q_matched_confusion_by_stratum", "confusion_by_page": "q_matched_confusion_page", "bootstrap": "q_matched_bootstrap", "gates": "q_matched_gates",
    "alignment": "q_alignment", "candidates": "q_candidate_summary", "paragraphs": "q_paragraph_best", "assignments": "q_one_to_one", "overlap": "q_cross_overlap", "fidelity": "q_span_fidelity_all", "coverage": "q_matched_coverage",
}
AUDIT = {
    "weighted_means": "q_weighted_mean", "strata": "q_stratum_detail", "estimate": "q_stratified_estimate", "reliability": "q_reliability_alpha_ac1", "intervals": "q_wilson",
    "queue": "q_adjudication_queue", "transitions": "q_transition_counts", "per_class": "q_per_class_prf", "macro": "q_macro_prf",
}
ANALYSES = {"ensemble": ENSEMBLE, "evaluation": EVALUATION, "audit": AUDIT}


def results(spark: SparkSession, sf_dir: str, analysis: str) -> dict[str, DataFrame]:
    known = catalogue.queries()
    return {name: known[query](spark, sf_dir) for name, query in ANALYSES[analysis].items()}


def export(tables: dict[str, DataFrame], out: str, parameters: dict | None = None) -> dict:
    """Writes every result as one ordered CSV and a manifest with the digest of its rows; returns the manifest.

    The digest is of the row set, so it does not depend on partitioning or file layout.
    """
    manifest: dict = {"parameters": parameters or {}, "outputs": {}}
    for name, df in tables.items():
        kept = materialize(df, name)
        digest = writers.row_set_digest(kept).first()
        manifest["outputs"][name] = {"columns": kept.columns, "rows": digest.n, "digest": digest.digest}
        writers.write_csv(kept, f"{out}/{name}", kept.columns, digits=12)
        discard(kept)
    if tables:
        spark = next(iter(tables.values())).sparkSession
        write_bytes(spark, f"{out.rstrip('/')}/manifest.json", json.dumps(manifest, indent=1, sort_keys=True).encode())
    return manifest


def verify(tables: dict[str, DataFrame], manifest: dict) -> DataFrame:
    """name, status of results whose rows differ from the manifest (changed, missing or new): empty if all hold."""
    spark = next(iter(tables.values())).sparkSession
    now = []
    for name, df in tables.items():
        d = writers.row_set_digest(df).first()
        now.append((name, d.digest, d.n))
    then = [(name, x["digest"], x["rows"]) for name, x in manifest["outputs"].items()]
    schema = "name string, digest string, n long"
    a, b = spark.createDataFrame(then, schema).alias("a"), spark.createDataFrame(now, schema).alias("b")
    status = F.when(F.col("a.name").isNull(), "new").when(F.col("b.name").isNull(), "missing").otherwise("changed")
    differs = F.col("a.name").isNull() | F.col("b.name").isNull() | (F.col("a.digest") != F.col("b.digest")) | (F.col("a.n") != F.col("b.n"))
    return a.join(b, F.col("a.name") == F.col("b.name"), "full").where(differs).select(F.coalesce("a.name", "b.name").alias("name"), status.alias("status"))
