"""Queries of the nine problems; each covers its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import bpe, canon, consensus, languages, mixing, neardup, quota, readability, survivor
from attestra.tables import materialize, read


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.all_reviews(read(spark, sf_dir, "reviewed_candidates"), read(spark, sf_dir, "review_labels"))


def _consensus(spark: SparkSession, sf_dir: str) -> consensus.Reviews:
    return consensus.Reviews(_reviews(spark, sf_dir))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates judged keep, with their code; a keep vote without a code counts for the decision only, and a candidate no one coded has no row."""
    kept = _consensus(spark, sf_dir).result().where("keep and label is not null")
    asked = read(spark, sf_dir, "reviewed_candidates").select(F.col("candidate_id").alias("item")).distinct()
    return kept.join(asked, "item", "left_semi").select(F.col("item").alias("candidate_id"), F.col("label").alias("final_code1"))


def p1_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir).reliability()


def p1_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.explode(F.array(F.struct(F.lit("decision").alias("measure"), F.col("decision").alias("label")), F.struct(F.lit("code").alias("measure"), F.col("code").alias("label")))).alias("p")
    long_ = _reviews(spark, sf_dir).select("item", parts).select("item", "p.*")
    out = consensus.krippendorff(long_, ["measure"], "item", "label")
    return out.select("measure", "n_items", "n_labels", *[F.round(c, 9).alias(c) for c in ("observed", "expected", "alpha")])


def _prototypes(spark: SparkSession, sf_dir: str):
    docs = read(spark, sf_dir, "documents")
    return languages.train(languages.labelled_sample(docs, "doc_id", "text", "lang"))


def _document_languages(spark: SparkSession, sf_dir: str, prototypes) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return languages.detect(docs, prototypes, ["doc_id", "lang"], "text", by_paragraph=True)


def p2_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _document_languages(spark, sf_dir, _prototypes(spark, sf_dir))
    return found.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.segment", "f.language", F.round("f.confidence", 6).alias("confidence"), "f.words")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    prototypes = _prototypes(spark, sf_dir)
    docs = _document_languages(spark, sf_dir, prototypes)
    all_ = F.array_distinct(F.expr("transform(found, x -> x.language)"))
    right = (F.size(all_) == 1) & F.coalesce(languages.label_language(F.col("lang")) == all_[0], F.lit(False))
    wrong = docs.where(~right).select(F.col("doc_id").cast("string").alias("record_key"), F.explode("found").alias("f"))
    documents = wrong.select(F.lit("documents").alias("table_name"), "record_key", F.col("f.segment").alias("segment"), F.col("f.language").alias("language")).distinct()

    outputs = read(spark, sf_dir, "provider_outputs").where(~canon.is_placeholder(F.col("quote"))).select("record_id", "doc_id", "quote")
    quotes = languages.detect(outputs, prototypes, ["record_id", "doc_id"], "quote", by_paragraph=False)
    quotes = materialize(quotes.select("record_id", "doc_id", all_.alias("langs")), "quotelangs")
    several = quotes.where(F.size("langs") > 1).select(F.lit("provider_outputs").alias("table_name"), F.col("record_id").cast("string").alias("record_key"), F.lit(0).alias("segment"), F.explode("langs").alias("language"))

    spoken = quotes.select("doc_id", F.explode("langs").alias("language")).distinct()
    only = spoken.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("language").alias("one"))
    # a document listed twice is labelled right only if every listing is
    agreed = F.when((F.count_if(F.col("label").isNull()) == 0) & (F.min("label") == F.max("label")), F.min("label"))
    manifest = read(spark, sf_dir, "corpus_manifest").select("doc_id", languages.label_language(F.col("language")).alias("label")).groupBy("doc_id").agg(agreed.alias("label"))
    bad = manifest.join(only, "doc_id").where(~((F.col("n") == 1) & F.coalesce(F.col("label") == F.col("one"), F.lit(False)))).select("doc_id")
    corpus = spoken.join(bad, "doc_id", "left_semi").select(F.lit("corpus_manifest").alias("table_name"), F.col("doc_id").alias("record_key"), F.lit(0).alias("segment"), "language")
    return documents.unionByName(corpus).unionByName(several)


def _looks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Texts of both quote fields without placeholders, and paragraph ids under their gold_id."""
    outputs = read(spark, sf_dir, "provider_outputs")
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("v")) for c in ("quote", "quote_en")])).alias("f")
    texts = outputs.select("record_id", fields).select("record_id", "f.*").where(~canon.is_placeholder(F.col("v")))
    return texts, read(spark, sf_dir, "reference_paragraphs").select("ref_id", "gold_id", "paragraph_id").where("gold_id is not null")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, paragraphs = _looks(spark, sf_dir)
    quotes = canon.same_look_pairs(texts, "record_id", ["field_name"], "v").select("field_name", "id_a", "id_b")
    keyed = canon.same_look_pairs(paragraphs, "ref_id", ["gold_id"], "paragraph_id").select(F.lit("paragraph_id").alias("field_name"), "id_a", "id_b")
    return quotes.union(keyed)


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The linear form of p4_found: every value's class of equal-looking values, quotes over all rows, paragraph ids under their gold_id."""
    texts, paragraphs = _looks(spark, sf_dir)
    quotes = canon.look_classes(texts, "record_id", ["field_name"], "v")
    keyed = canon.look_classes(paragraphs, "ref_id", ["gold_id"], "paragraph_id")
    columns = ["field_name", "record_id", "class_id", "rows", "spellings"]
    return quotes.select(*columns).union(keyed.select(F.lit("paragraph_id"), "ref_id", "class_id", "rows", "spellings"))


def _near(spark: SparkSession, sf_dir: str) -> neardup.NearDuplicates:
    outputs = read(spark, sf_dir, "provider_outputs").select("record_id", "quote", "quote_en")
    return neardup.NearDuplicates(neardup.text_rows(outputs, "record_id", ["quote", "quote_en"]), threshold=0.7)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _near(spark, sf_dir).row_pairs(neardup.row_of_text(2))
    return pairs.select(F.col("a").alias("record_id_a"), F.col("b").alias("record_id_b"))


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir).rows(neardup.row_of_text(2))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivor.statement_survivors(read(spark, sf_dir, "provider_outputs"), read(spark, sf_dir, "codebook"))


def p3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivor.statement_records(read(spark, sf_dir, "provider_outputs"), read(spark, sf_dir, "codebook"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read(spark, sf_dir, "documents"))


def _quota(spark: SparkSession, sf_dir: str) -> quota.QuotaSample:
    mapping, manifest = read(spark, sf_dir, "candidate_mapping"), read(spark, sf_dir, "sampled_validation_freeze_manifest")
    return quota.QuotaSample(mapping, manifest, ["language", "origin_type"], "sample", "candidate_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quota(spark, sf_dir).report().where("shortfall > 0").select("language", "origin_type")


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quota(spark, sf_dir).report()


def _shares(spark: SparkSession, sf_dir: str, share: str) -> DataFrame:
    mapping, manifest = read(spark, sf_dir, "candidate_mapping"), read(spark, sf_dir, "sampled_validation_freeze_manifest")
    targets = manifest.withColumn("share", F.expr(share))
    out = quota.QuotaSample(mapping, targets, ["language", "origin_type"], "share", "candidate_id", total=F.col("sample")).report()
    return out.select("language", "origin_type", F.round("target_share", 9).alias("target_share"), "available", "quota", F.round("actual_share", 9).alias("actual_share"), "shortfall")


def p6_proportional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many candidates as the manifest samples in all, in the proportions of its populations."""
    return _shares(spark, sf_dir, "population")


def p6_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many candidates as the manifest samples in all, with the same share for every stratum: small strata run out and the others take over."""
    return _shares(spark, sf_dir, "1")


def p6_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quota(spark, sf_dir).sample()


def _mix(spark: SparkSession, sf_dir: str) -> mixing.SourceMix:
    """Leaves: scope of the source document, the language its label names (none if it names none), source."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "manifest_doc_id", languages.label_language(F.col("lang")).alias("language"), "source", "text")
    sized = materialize(bpe.with_token_counts(docs), "sizes")
    scopes = read(spark, sf_dir, "corpus_manifest").groupBy(F.lower("doc_id").alias("_doc")).agg(F.min("scope").alias("domain"))
    sized = sized.join(scopes, F.lower("manifest_doc_id") == F.col("_doc"), "left")
    return mixing.SourceMix(sized.select("doc_id", "domain", "language", "source", "n_tokens"), read(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).short_sources()


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).report()


def p8_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).levels()


def p8_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).selection()


def _graded(spark: SparkSession, sf_dir: str):
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return readability.graded(docs, read(spark, sf_dir, "reading_labels"), _prototypes(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graded(spark, sf_dir)[0].select("doc_id", "band")


def p9_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, model = _graded(spark, sf_dir)
    return found.select("doc_id", F.round("grade", 6).alias("grade"), "band", F.lit(model.cv_accuracy).cast("double").alias("cv_accuracy"))


def p9_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source (null: without one), labelled documents and share of them graded right while the source was held out; all_sources has the total."""
    _, model = _graded(spark, sf_dir)
    rows = [("source", *r) for r in model.cv_sources] + [("all_sources", None, sum(r[1] for r in model.cv_sources), sum(r[2] for r in model.cv_sources))]
    found = spark.createDataFrame(rows, "level string, source string, n long, right long")
    return found.select("level", "source", "n", F.round(F.try_divide(F.col("right").cast("double"), "n"), 6).alias("accuracy"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_agreement, p1_reliability, p2_found, p2_segments, p3_found, p3_records, p4_found, p4_classes, p5_found, p5_classes, p6_found, p6_report, p6_proportional, p6_balanced, p6_sample, p7_ids, p8_found, p8_report, p8_levels, p8_selection, p9_found, p9_grades, p9_accuracy)}


STRATA_SQL = """WITH m AS (SELECT lower(trim(language)) l, lower(trim(origin_type)) o, count(DISTINCT candidate_id) n FROM candidate_mapping GROUP BY 1, 2),
    s AS (SELECT language, origin_type, sample target, coalesce(n, 0) available FROM sampled_validation_freeze_manifest f LEFT JOIN m ON l = lower(trim(f.language)) AND o = lower(trim(f.origin_type))),
    q AS (SELECT *, least(available, greatest(target, (available > 0)::INT)) quota FROM s)"""
AGREEMENT_SQL = """WITH r AS (SELECT candidate_id item, 'martin' who, lower(trim(inclusion_decision_martin)) d, trim(final_code1_martin) c, TIMESTAMP '0001-01-01' t FROM reviewed_candidates UNION ALL
    SELECT candidate_id, 'dominik', lower(trim(inclusion_decision_dominik)), trim(final_code1_dominik), TIMESTAMP '0001-01-01' FROM reviewed_candidates UNION ALL
    SELECT candidate_id, lower(trim(reviewer)), lower(trim(inclusion_decision)), trim(final_code1), coalesce(reviewed_at, TIMESTAMP '0001-01-01') FROM review_labels),
    l AS (SELECT item, who, d, nullif(c, '') c FROM (SELECT *, row_number() OVER (PARTITION BY item, who ORDER BY t DESC, d DESC, coalesce(c, '') DESC) k FROM r
      WHERE item IS NOT NULL AND who IS NOT NULL AND d IN ('keep', 'exclude')) WHERE k = 1),
    v AS (SELECT 'decision' measure, item, d lab FROM l UNION ALL SELECT 'code', item, c FROM l WHERE c IS NOT NULL),
    n AS (SELECT measure, item, lab, count(*) n, sum(count(*)) OVER (PARTITION BY measure, item) m FROM v GROUP BY 1, 2, 3), k AS (SELECT * FROM n WHERE m > 1),
    o AS (SELECT measure, count(DISTINCT item) n_items, sum(n)::BIGINT n_labels, sum(n * (m - n) / (m - 1)::DOUBLE) / sum(n) observed FROM k GROUP BY 1),
    e AS (SELECT measure, (sum(n)::DOUBLE ** 2 - sum(n::DOUBLE ** 2)) / (sum(n)::DOUBLE * (sum(n) - 1)) expected FROM (SELECT measure, lab, sum(n) n FROM k GROUP BY 1, 2) GROUP BY 1)
    SELECT measure, n_items, n_labels, round(observed, 9) observed, round(expected, 9) expected, round(1 - observed / nullif(expected, 0), 9) alpha FROM o JOIN e USING (measure)"""


def _shares_sql(share: str) -> str:
    """Largest remainder with floors of 1 and availability caps: the factor is looked for at every floor and cap, then whole quotas by largest fraction."""
    return f"""WITH m AS (SELECT lower(trim(language)) l, lower(trim(origin_type)) o, count(DISTINCT candidate_id) n FROM candidate_mapping GROUP BY 1, 2),
    s AS (SELECT lower(trim(f.language)) l, lower(trim(f.origin_type)) o, min(f.language) AS language, min(f.origin_type) origin_type, sum({share})::DOUBLE s, sum(f.sample)::DOUBLE w FROM sampled_validation_freeze_manifest f GROUP BY 1, 2),
    t AS (SELECT s.*, coalesce(n, 0) available, least(1, coalesce(n, 0))::DOUBLE lo, coalesce(n, 0)::DOUBLE hi, sum(w) OVER () total FROM s LEFT JOIN m USING (l, o)),
    p AS (SELECT DISTINCT unnest([lo / s, hi / s]) y FROM t), g AS (SELECT y, (SELECT sum(greatest(lo, least(hi, p.y * s))) FROM t) v FROM p),
    a AS (SELECT max(y) y0, max(v) v0 FROM g WHERE v <= (SELECT max(total) FROM t) + 1e-9), b AS (SELECT min(y) y1, min(v) v1 FROM g, a WHERE y > y0),
    f AS (SELECT coalesce(CASE WHEN v1 > v0 THEN y0 + (y1 - y0) * ((SELECT max(total) FROM t) - v0) / (v1 - v0) ELSE y0 END, 0) k FROM a, b),
    x AS (SELECT t.*, greatest(lo, least(hi, k * s)) x FROM t, f), q AS (SELECT *, floor(x + 1e-6) q FROM x),
    r AS (SELECT *, row_number() OVER (ORDER BY round(x - q, 9) DESC, l, o) <= round(sum(x) OVER ()) - sum(q) OVER () AND q < hi more FROM q), z AS (SELECT *, (q + more::INT)::BIGINT quota, s / sum(s) OVER () ts FROM r)
    SELECT language, origin_type, round(ts, 9) target_share, available, quota, round(quota / (sum(quota) OVER ())::DOUBLE, 9) actual_share, greatest(floor(ts * total + 1e-6) - quota, 0)::BIGINT shortfall FROM z"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_agreement": AGREEMENT_SQL,
        "p6_proportional": _shares_sql("f.population"),
        "p6_balanced": _shares_sql("1"),
        "p6_found": STRATA_SQL + " SELECT language, origin_type FROM q WHERE target > quota",
        "p6_report": STRATA_SQL + " SELECT language, origin_type, target, available, quota::BIGINT quota, greatest(target - quota, 0)::BIGINT shortfall FROM q",
    }
