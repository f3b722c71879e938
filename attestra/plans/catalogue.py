"""Registry of the general queries and their SQL oracles."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.functions import scalars
from attestra.operators import allocate, assign, evaluate, expectations, flatten, inference, reliability, score, survey, textmatch
from attestra.plans.bindings import CLEAN, MATCH, PROVIDERS, assigned_statements, candidates, design, entities, evidence, matched_paragraphs, norm_sql, page_texts, paragraph_edges, paragraphs, quoted, reviews, sql, statements
from attestra.plans.goals import GATED, GOALS, LEXICON, SIGNALS, WHOLE_CODES
from attestra.tables import materialize, read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, *views: str):
    """Registers a query under its function's name, with its oracle if SQL can express it."""

    def wrap(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = sql(oracle, *views)
        return f

    return wrap


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def big(*names: str) -> list:
    return [F.col(n).cast("long").alias(n) for n in names]


# --- allocation ---------------------------------------------------------------------------------------


def allocation(spark: SparkSession, sf_dir: str, hits: bool = False) -> DataFrame:
    cells = allocate.contributions(evidence(spark, sf_dir))
    if hits:
        cells = score.with_hits(cells, LEXICON)
    fanned = allocate.variants(cells, PROVIDERS)
    return fanned.join(candidates(spark, sf_dir).select("candidate_id", "doc_id", "language", "origin_type"), "candidate_id")


@query("SELECT variant, candidate_id, round(sum(mass), 6) mass, count(*) AS cells FROM alloc GROUP BY 1, 2", "alloc")
def q_alloc_candidate_mass(spark, d):
    return allocation(spark, d).groupBy("variant", "candidate_id").agg(F.round(F.sum("mass"), 6).alias("mass"), F.count(F.lit(1)).alias("cells"))


DIMENSIONS = ("code", "family", "odr", "direction", "language")


@query(
    """, long AS (SELECT variant, mass, unnest([{'d': 'code', 'c': code}, {'d': 'family', 'c': family}, {'d': 'odr', 'c': coalesce(odr, '')}, {'d': 'direction', 'c': direction},
    {'d': 'language', 'c': coalesce(language, '')}]) x FROM alloc), g AS (SELECT variant, x.d dimension, x.c category, sum(mass) mass FROM long GROUP BY 1, 2, 3)
    SELECT variant, dimension, category, round(mass, 6) mass, round(mass / sum(mass) OVER (PARTITION BY variant, dimension), 6) AS share FROM g""",
    "alloc",
)
def q_alloc_distribution(spark, d):
    return allocate.distributions(allocation(spark, d), DIMENSIONS).select("variant", "dimension", "category", *r6("mass", "share"))


@query("SELECT variant, candidate_id, mass FROM (SELECT variant, candidate_id, sum(mass) mass FROM alloc GROUP BY 1, 2) WHERE abs(mass - 1) > 1e-9", "alloc")
def q_alloc_mass_check(spark, d):
    return allocate.mass_check(allocation(spark, d))


@query(
    """, s AS (SELECT candidate_id, provider, list_sort(list(DISTINCT code)) code, list_sort(list(DISTINCT family)) family, list_sort(list(DISTINCT odr) FILTER (odr IS NOT NULL)) odr FROM ev GROUP BY 1, 2),
    b AS (SELECT unnest([{'m': 'code', 's': l.code = r.code}, {'m': 'family', 's': l.family = r.family}, {'m': 'odr', 's': coalesce(l.odr, []) = coalesce(r.odr, [])}]) x
    FROM s l JOIN s r ON l.candidate_id = r.candidate_id AND l.provider = 'openai' AND r.provider = 'claude')
    SELECT x.m measure, count(*) shared, count(*) FILTER (x.s) agree, round(count(*) FILTER (x.s) / count(*)::DOUBLE, 6) rate FROM b GROUP BY 1""",
    "ev",
)
def q_provider_agreement(spark, d):
    ev = evidence(spark, d).withColumn("family", scalars.family("code"))
    return allocate.set_agreement(ev, *PROVIDERS, {c: F.col(c) for c in ("code", "family", "odr")}).select("measure", "shared", "agree", *r6("rate"))


@query("SELECT variant, count(DISTINCT candidate_id) candidates, count(DISTINCT doc_id) documents, round(sum(mass), 6) mass FROM alloc GROUP BY 1", "alloc")
def q_variant_population(spark, d):
    return allocation(spark, d).groupBy("variant").agg(F.count_distinct("candidate_id").alias("candidates"), F.count_distinct("doc_id").alias("documents"), F.round(F.sum("mass"), 6).alias("mass"))


@query(
    """SELECT origin_type, count(*) candidates, count(*) FILTER (openai_statement_ids <> '') with_openai, count(*) FILTER (claude_statement_ids <> '') with_claude,
    count(DISTINCT doc_id) documents FROM cand GROUP BY 1""",
    "cand",
)
def q_origin_counts(spark, d):
    has = lambda p: F.count_if(F.size(scalars.split_ids(f"{p}_statement_ids")) > 0).alias(f"with_{p}")
    return candidates(spark, d).groupBy("origin_type").agg(F.count(F.lit(1)).alias("candidates"), has("openai"), has("claude"), F.count_distinct("doc_id").alias("documents"))


@query(
    """SELECT candidate_id, provider, code, odr, direction, relation, strength::BIGINT strength, sha256(txt) text_hash FROM cells""",
    "cells",
)
def q_representative_pick(spark, d):
    cells = allocate.contributions(evidence(spark, d))
    return cells.select("candidate_id", "provider", "code", "odr", "direction", "relation", *big("strength"), F.sha2("text", 256).alias("text_hash"))


# --- flattening ---------------------------------------------------------------------------------------


def nested(spark: SparkSession, sf_dir: str, provider: str) -> DataFrame:
    """Provider rows as response documents (the inverse of the flattening): a request's units, a unit's statements in record order."""
    raw = read(spark, sf_dir, "provider_outputs").where(F.col("provider") == provider)
    fields = ["block_id", "quote", "quote_en", "code1", "odr", "privacy_direction", "privacy_relation", "strength", "source_mode"]
    units = raw.groupBy("request_id", "unit_id").agg(F.max("status").alias("status"), F.sort_array(F.collect_list(F.struct("record_id", *fields))).alias("s"))
    units = units.withColumn("statements", F.transform("s", lambda x: F.struct(*[x[f].alias(f) for f in fields])))
    return units.groupBy("request_id").agg(F.collect_list(F.struct("unit_id", "status", "statements")).alias("units"))


@query(
    """SELECT provider || ':' || unit_id || ':S' || lpad(n::VARCHAR, 3, '0') statement_id, provider, request_id, unit_id, n::BIGINT ordinal, code1, sha256(coalesce(quote, '')) quote_hash, doc_id, page::BIGINT page
    FROM (SELECT *, row_number() OVER (PARTITION BY provider, request_id, unit_id ORDER BY record_id) n FROM provider_outputs) JOIN
    (SELECT unit_id, min(doc_id) doc_id, min(page) page FROM provider_outputs GROUP BY 1) u USING (unit_id)""".replace("doc_id, page::BIGINT", "u.doc_id, u.page::BIGINT"),
)
def q_flatten_nested(spark, d):
    both = flatten.flatten(nested(spark, d, "openai"), "openai").unionByName(flatten.flatten(nested(spark, d, "claude"), "claude"))
    units = read(spark, d, "provider_outputs").groupBy("unit_id").agg(F.min("doc_id").alias("doc_id"), F.min("page").alias("page"))
    out = flatten.with_units(both, units, ["doc_id", "page"])
    return out.select("statement_id", "provider", "request_id", "unit_id", *big("ordinal"), "code1", F.sha2(F.coalesce("quote", F.lit("")), 256).alias("quote_hash"), "doc_id", *big("page"))


@query("SELECT candidate_id, provider, statement_id, s.code1 code FROM ids JOIN st s USING (statement_id)".replace("provider, statement_id", "ids.provider, statement_id"), "st", "ids")
def q_split_ids(spark, d):
    ids = flatten.candidate_statements(candidates(spark, d), {p: f"{p}_statement_ids" for p in PROVIDERS}).distinct()
    return ids.join(statements(spark, d).select("statement_id", F.col("code1").alias("code")), "statement_id").select("candidate_id", "provider", "statement_id", "code")


@query("SELECT DISTINCT statement_id FROM ids ANTI JOIN st USING (statement_id)", "st", "ids")
def q_missing_statements(spark, d):
    ids = flatten.candidate_statements(candidates(spark, d), {p: f"{p}_statement_ids" for p in PROVIDERS})
    return expectations.missing_keys(ids, statements(spark, d), ["statement_id"])


@query(
    """, m AS (SELECT unit_id, max(record_id) record_id, count(*) n FROM provider_outputs WHERE qc_status IS DISTINCT FROM 'pass' GROUP BY 1),
    r AS (SELECT unit_id, max(record_id) record_id, count(*) n FROM provider_outputs WHERE qc_status = 'pass' GROUP BY 1)
    SELECT m.unit_id, r.n IS NOT NULL replaced, coalesce(r.record_id, m.record_id) record_id, coalesce(r.n, m.n) n FROM m LEFT JOIN r ON m.unit_id = r.unit_id AND r.n >= 1""".lstrip(", ").replace("m AS", "WITH m AS", 1),
)
def q_retry_merge(spark, d):
    raw = read(spark, d, "provider_outputs")
    passed = F.col("qc_status").eqNullSafe("pass")
    unit = lambda rows: rows.groupBy("unit_id").agg(F.max("record_id").alias("record_id"), F.count(F.lit(1)).alias("n"))
    return flatten.retry_merge(unit(raw.where(~passed)), unit(raw.where(passed)), "unit_id", F.col("n") >= 1)


@query(
    """SELECT p.record_id, CASE WHEN m.en THEN NULL ELSE p.quote_en END quote_en FROM provider_outputs p LEFT JOIN
    (SELECT doc_id, bool_or(split_part(replace(lower(trim(language)), '_', '-'), '-', 1) IN ('en', 'eng', 'english')) en FROM corpus_manifest GROUP BY 1) m USING (doc_id)"""
)
def q_null_translation(spark, d):
    langs = read(spark, d, "corpus_manifest").groupBy("doc_id").agg(F.max(F.when(scalars.names_english("language"), F.col("language"))).alias("language"))
    return flatten.drop_translation(read(spark, d, "provider_outputs").select("record_id", "doc_id", "quote_en").join(langs, "doc_id", "left"), "language").select("record_id", "quote_en")


BLANK = r"[ \t\n\x0B\f\r]"


@query(
    r"""WITH RECURSIVE p AS (SELECT doc_id, -1::BIGINT ordinal, '' piece, coalesce(text, '') AS rest FROM documents UNION ALL
    SELECT doc_id, ordinal + 1, left(rest, n), substr(rest, n + 1) FROM (SELECT *, CASE WHEN length(rest) <= 2000 THEN greatest(length(rest), 1) WHEN regexp_matches(substr(rest, 2, 2000), '[ \t\n\x0B\f\r]')
      THEN length(regexp_extract(substr(rest, 2, 2000), '(?s)^.*[ \t\n\x0B\f\r]')) ELSE 2000 END n FROM p WHERE rest <> '' OR ordinal = -1))
    SELECT doc_id, ordinal, piece FROM p WHERE ordinal >= 0""".replace("\\", "\\")
)
def q_paginate(spark, d):
    return flatten.paginate(read(spark, d, "documents"), "doc_id", "text", 2000).select("doc_id", *big("ordinal"), "piece")


BARE = r"regexp_replace({c}, '[\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', '', 'g')"


@query(
    f""", pg AS (SELECT doc_id, page, string_agg(text, chr(10) || chr(10) ORDER BY text) source FROM reference_paragraphs GROUP BY 1, 2), s AS (SELECT statement_id, source_mode, quote, source, {BARE.format(c="quote")} q, {BARE.format(c="source")} b FROM st LEFT JOIN pg USING (doc_id, page)),
    k AS (SELECT *, CASE WHEN quote <> '' AND contains(source, quote) THEN 'exact' WHEN q <> '' AND contains(b, q) THEN CASE WHEN contains(substr(b, instr(b, q) + 1), q) THEN 'ambiguous' ELSE 'restored' END WHEN source_mode <> 'text' THEN 'render' ELSE 'unsupported' END quote_status FROM s)
    SELECT statement_id, quote_status, CASE WHEN quote_status IN ('exact', 'ambiguous') THEN quote END quote_span FROM k""",
    "st",
)
def q_canonical_quotes(spark, d):
    st = statements(spark, d).select("statement_id", "doc_id", "page", "quote", (F.col("source_mode") != "text").alias("rendered"))
    pages = read(spark, d, "reference_paragraphs").groupBy("doc_id", "page").agg(F.concat_ws("\n\n", F.sort_array(F.collect_list("text"))).alias("source"))
    return flatten.canonical_quotes(st.join(pages, ["doc_id", "page"], "left"), "quote", "source", "rendered").select("statement_id", "quote_status", "quote_span")


# --- scores -------------------------------------------------------------------------------------------


def _hits(text: str, goal: str) -> str:
    return "(" + " + ".join(f"regexp_matches(lower({text}), '{p}')::INT" for p in LEXICON[goal]) + ")"


def _signal(goal: str) -> str:
    return f"CASE CASE WHEN starts_with(code, '{WHOLE_CODES}') THEN code ELSE array_to_string(string_split(code, '.')[1:2], '.') END " + " ".join(f"WHEN '{c}' THEN {w[goal]}::DOUBLE" for c, w in SIGNALS.items() if goal in w) + " ELSE 0e0 END"


ELIGIBLE = """elig AS (SELECT *, string_split(doc_id, '_')[1] entity, CASE odr WHEN 'decision' THEN 1e0 ELSE 5e-1 END odr_weight, mass * CASE odr WHEN 'decision' THEN 1e0 ELSE 5e-1 END * strength weight,
    CASE direction WHEN 'increases' THEN 1e0 WHEN 'decreases' THEN -1e0 WHEN 'conditional' THEN -25e-2 ELSE 0e0 END sgn,
    CASE relation WHEN 'from_state' THEN 1e0 ELSE 5e-1 END rel FROM alloc WHERE odr IN ('decision', 'proposal') AND code NOT LIKE 'NONE%')"""
ENTITY = (
    ELIGIBLE
    + """, es AS (SELECT variant, entity, sum(mass) mass, count(*) contributions, count(DISTINCT doc_id) documents,
    sum(CASE WHEN family = 'PRIV' THEN mass ELSE 0 END) / nullif(sum(CASE WHEN family IN ('PRIV', 'AML', 'KYC', 'TECH') THEN mass ELSE 0 END), 0) family_share,
    sum(weight * sgn * rel) / sum(mass) posture,
    coalesce(sum(weight * sgn) FILTER (direction <> 'neutral' AND relation = 'from_state') / nullif(sum(weight) FILTER (direction <> 'neutral' AND relation = 'from_state'), 0), 0e0) state_raw, """
    + ", ".join(f"coalesce(sum(({_hits('txt', g)} + {_signal(g)}) * weight) / nullif(sum(weight), 0), 0e0) raw_{g}" for g in LEXICON)
    + " FROM elig GROUP BY 1, 2)"
)
RAW = [f"raw_{g}" for g in GOALS]


def _calibrated_sql(c: str) -> str:
    v, lo, mid, hi = c, f"{c}_q[1]", f"{c}_q[2]", f"{c}_q[3]"
    lo = f"(CASE WHEN {mid} <= {lo} THEN {mid} - 1e-6 ELSE {lo} END)"
    hi = f"(CASE WHEN {hi} <= {mid} THEN {mid} + 1e-6 ELSE {hi} END)"
    return f"least(0.99e0, greatest(0.01e0, CASE WHEN {v} >= {mid} THEN 5e-1 + 45e-2 * least(1e0, ({v} - {mid}) / ({hi} - {mid})) ELSE 5e-2 + 45e-2 * greatest(0e0, ({v} - {lo}) / ({mid} - {lo})) END))"


CALIBRATED = (
    ENTITY
    + ", q AS (SELECT "
    + ", ".join(f"quantile_cont({c}, [0.05, 0.5, 0.95]) {c}_q" for c in [*RAW, "state_raw"])
    + " FROM es WHERE variant = 'ensemble'), c0 AS (SELECT es.*, "
    + ", ".join(f"{_calibrated_sql('raw_' + g)} score_{g}" for g in GOALS)
    + f", {_calibrated_sql('state_raw')} state_score FROM es, q), c1 AS (SELECT * REPLACE (score_{GATED} * (35e-2 + 65e-2 * state_score) AS score_{GATED}), score_{GATED} score_{GATED}_ungated FROM c0)"
)
DOMINANT = (
    CALIBRATED
    + f", dom0 AS (SELECT *, list_reverse_sort([{', '.join('score_' + g for g in GOALS)}]) ranked FROM c1), dom AS (SELECT *, ranked[1] dominant_score, ranked[2] second_score, CASE ranked[1] "
    + " ".join(f"WHEN score_{g} THEN '{g}'" for g in GOALS)
    + " END dominant FROM dom0)"
)


#: Entities that stand for several, left out of correlations.
COMPOSITE = ["XE"]


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.entity_scores(score.eligible(allocation(spark, sf_dir, hits=True)), LEXICON, SIGNALS, kept_prefix=WHOLE_CODES)


def _calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the entity table feeds both the thresholds and the scores: written once
    return score.calibrated(materialize(_entities(spark, sf_dir), "entities"), GOALS, GATED, F.col("variant") == "ensemble")


@query(", " + ELIGIBLE + " SELECT variant, candidate_id, provider, code, odr, direction, relation, strength::BIGINT strength, entity, odr_weight, round(weight, 6) weight, direction <> 'neutral' is_privacy FROM elig", "alloc")
def q_eligible_weights(spark, d):
    rows = score.eligible(allocation(spark, d))
    return rows.select("variant", "candidate_id", "provider", "code", "odr", "direction", "relation", *big("strength"), "entity", "odr_weight", *r6("weight"), "is_privacy")


@query(", " + ENTITY + " SELECT variant, entity, contributions, documents, " + ", ".join(f"round({c}, 6) {c}" for c in ["mass", "family_share", "posture", "state_raw", *RAW]) + " FROM es", "alloc")
def q_entity_scores(spark, d):
    return _entities(spark, d).select("variant", "entity", "contributions", "documents", *r6("mass", "family_share", "posture", "state_raw", *RAW))


@query(
    ", " + CALIBRATED + ", ent AS (SELECT string_split(doc_id, '_')[1] entity, avg(pages) pages FROM (SELECT DISTINCT * FROM corpus_manifest) GROUP BY 1) SELECT variant, entity, round(pages, 6) pages, entity IN ('XE') is_composite, "
    + ", ".join(f"round({c}, 6) {c}" for c in ["state_score", f"score_{GATED}_ungated", *[f"score_{g}" for g in GOALS]]) + " FROM c1 LEFT JOIN ent USING (entity)",
    "alloc",
)
def q_entity_calibrated(spark, d):
    out = score.with_dimension(_calibrated(spark, d), entities(spark, d).select("entity", "pages"), "entity", COMPOSITE)
    return out.select("variant", "entity", *r6("pages"), "is_composite", *r6("state_score", f"score_{GATED}_ungated", *[f"score_{g}" for g in GOALS]))


@query(", " + DOMINANT + " SELECT variant, entity, dominant, round(dominant_score, 6) dominant_score, round(second_score, 6) second_score, dominant_score - second_score < 0.1 narrow FROM dom", "alloc")
def q_dominant_centre(spark, d):
    return score.dominant(_calibrated(spark, d), GOALS).select("variant", "entity", "dominant", *r6("dominant_score", "second_score"), "narrow")


@query(", " + DOMINANT + " SELECT variant, " + ", ".join(f"count(DISTINCT entity) FILTER (dominant = '{g}') {g}" for g in GOALS) + " FROM dom GROUP BY 1", "alloc")
def q_composition_pivot(spark, d):
    return score.composition(score.dominant(_calibrated(spark, d), GOALS), GOALS)


@query("SELECT doc_id, " + ", ".join(f"{_hits(chr(39) * 2 + ' || coalesce(text, ' + chr(39) * 2 + ')', g)}::BIGINT hits_{g}" for g in GOALS) + " FROM documents")
def q_keyword_hits(spark, d):
    return read(spark, d, "documents").select("doc_id", *[scalars.keyword_hits("text", LEXICON[g]).cast("long").alias(f"hits_{g}") for g in GOALS])


@query(", " + ENTITY + " SELECT entity, round(posture, 6) posture, row_number() OVER (ORDER BY round(posture, 6) DESC, entity) AS place, round(max(abs(posture)) OVER (), 6) max_abs FROM es WHERE variant = 'ensemble'", "alloc")
def q_rank_posture(spark, d):
    rows = _entities(spark, d).where("variant = 'ensemble'").select("entity", "posture")
    top = rows.agg(F.round(F.max(F.abs("posture")), 6).alias("max_abs"))
    place = F.row_number().over(Window.orderBy(F.desc(F.round("posture", 6)), "entity"))
    return rows.withColumn("place", place.cast("long")).join(F.broadcast(top), F.lit(True)).select("entity", *r6("posture"), "place", "max_abs")


# --- evaluation ---------------------------------------------------------------------------------------

CONFUSION = """count(*) FILTER (truth = 'positive' AND {p}) tp, count(*) FILTER (truth = 'negative' AND {p}) fp, count(*) FILTER (truth = 'positive' AND NOT {p}) fn, count(*) FILTER (truth = 'negative' AND NOT {p}) tn"""
RATES = "round(tp::DOUBLE / nullif(tp + fp, 0), 6) AS \"precision\", round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS recall, round(coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0e0), 6) f1"


def _rated(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "tp", "fp", "fn", "tn", *r6("precision", "recall", "f1"))


@query(", c AS (SELECT unnest(['openai', 'claude', 'any']) who, unnest([found_openai, found_claude, found_any]) p, truth FROM par), k AS (SELECT who, " + CONFUSION.format(p="p") + f" FROM c GROUP BY 1) SELECT *, {RATES} FROM k", "par")
def q_confusion_overall(spark, d):
    return _confusion_overall(paragraphs(spark, d))


def _confusion_overall(par: DataFrame) -> DataFrame:
    who = F.explode(F.array(*[F.struct(F.lit(w).alias("who"), F.col(f"found_{w}").alias("p")) for w in ("openai", "claude", "any")])).alias("x")
    return _rated(evaluate.confusion(par.select("truth", who).select("truth", "x.*"), "p", by=["who"]), "who")


@query(", k AS (SELECT stratum, " + CONFUSION.format(p="found_any") + f" FROM par WHERE stratum IS NOT NULL GROUP BY ROLLUP (stratum)) SELECT *, {RATES} FROM k", "par")
def q_confusion_by_stratum(spark, d):
    return _rated(evaluate.confusion_rollup(paragraphs(spark, d), "found_any", "stratum"), "stratum")


@query(
    ", pages AS (SELECT doc_id, page, CASE WHEN bool_or(truth = 'positive') THEN 'positive' ELSE 'negative' END truth, bool_or(found_any) p FROM par WHERE truth IN ('positive', 'negative') GROUP BY 1, 2), k AS (SELECT "
    + CONFUSION.format(p="p") + f" FROM pages) SELECT *, {RATES} FROM k",
    "par",
)
def q_confusion_page(spark, d):
    return _rated(evaluate.page_confusion(paragraphs(spark, d), "found_any", ["doc_id", "page"]))


PER_CLASS = """, l AS (SELECT truth_code label, 1 s, 0 p, (truth_code = pred)::INT t FROM t UNION ALL SELECT pred, 0, 1, 0 FROM t), k AS (SELECT label, sum(s)::BIGINT support, sum(p)::BIGINT predicted,
    sum(coalesce(t, 0))::BIGINT tp FROM l WHERE label IS NOT NULL GROUP BY 1), k2 AS (SELECT *, coalesce(tp::DOUBLE / nullif(predicted, 0), 0) pr, coalesce(tp::DOUBLE / nullif(support, 0), 0) re FROM k),
    k3 AS (SELECT *, coalesce(2 * pr * re / nullif(pr + re, 0), 0e0) f1 FROM k2)"""
REVIEW_CODES = "WITH t AS (SELECT final_code1_martin truth_code, final_code1_dominik pred FROM reviewed_candidates)"


@query(REVIEW_CODES + PER_CLASS + ' SELECT label, support, predicted, tp, round(pr, 6) AS "precision", round(re, 6) recall, round(f1, 6) f1 FROM k3')
def q_per_class_prf(spark, d):
    out = evaluate.per_class(read(spark, d, "reviewed_candidates"), "final_code1_martin", "final_code1_dominik")
    return out.select("label", *big("support", "predicted", "tp"), *r6("precision", "recall", "f1"))


@query(REVIEW_CODES + PER_CLASS + " SELECT round(avg(pr), 6) macro_precision, round(avg(re), 6) macro_recall, round(avg(f1), 6) macro_f1, round(sum(tp)::DOUBLE / sum(support), 6) accuracy, count(*) FILTER (support = 0 OR predicted = 0) degenerate FROM k3")
def q_macro_prf(spark, d):
    return evaluate.macro(evaluate.per_class(read(spark, d, "reviewed_candidates"), "final_code1_martin", "final_code1_dominik")).select(*r6("macro_precision", "macro_recall", "macro_f1", "accuracy"), "degenerate")


@query(
    """, p AS (SELECT count(*) FILTER (truth = 'positive' AND found_any) tp, count(*) FILTER (truth = 'negative' AND found_any) fp, count(*) FILTER (truth = 'positive' AND NOT found_any) fn FROM par WHERE stratum = 'probability'),
    s AS (SELECT count(*) FILTER (truth = 'positive' AND found_any) tp, count(*) FILTER (truth = 'positive') positives FROM par WHERE stratum = 'stress_long'),
    a AS (SELECT count(*) FILTER (truth = 'positive') positives, count(*) FILTER (found_any) n, count(*) FILTER (truth = 'positive' AND reference_code <> '') coded,
    count(*) FILTER (truth = 'positive' AND reference_code <> '' AND reference_code = found_code) hit FROM par),
    m AS (SELECT p.tp::DOUBLE / nullif(p.tp + p.fn, 0) recall, p.tp::DOUBLE / nullif(p.tp + p.fp, 0) prec, s.tp::DOUBLE / nullif(s.positives, 0) sr, s.positives sp, a.n::DOUBLE / nullif(a.positives, 0) workload, a.coded, a.hit::DOUBLE / nullif(a.coded, 0) cr FROM p, s, a)
    SELECT round(recall, 6) recall, round(prec, 6) AS "precision", round(sr, 6) stress_recall, sp stress_positives, round(workload, 6) workload, coded, round(cr, 6) code_recall,
    CASE WHEN recall >= 0.9 AND recall >= 0.85 THEN 'pass' ELSE 'fail' END e1, CASE WHEN sp >= 15 AND sr >= 0.85 THEN 'pass' ELSE 'fail' END e2, CASE WHEN prec >= 0.8 AND workload <= 3 THEN 'pass' ELSE 'fail' END e3,
    CASE WHEN coded >= 15 AND cr >= 0.8 THEN 'pass' ELSE 'fail' END c1 FROM m""",
    "par",
)
def q_gates(spark, d):
    """The part SQL can check: the point recall as its own bound, found paragraphs as workload. ``q_matched_gates`` has the gates."""
    m = _gate_measures(paragraphs(spark, d)).withColumns({"recall_low": F.col("recall"), "workload": F.try_divide(F.col("found").cast("double"), F.col("positives"))})
    return _gates(m)


def _gate_measures(par: DataFrame) -> DataFrame:
    pos, prob, found = F.col("truth") == "positive", F.col("stratum") == "probability", F.col("found_any")
    stress, coded = F.col("stratum") == "stress_long", pos & (F.col("reference_code") != "")
    ratio = lambda a, b: F.try_divide(F.count_if(a).cast("double"), F.count_if(b))
    return par.agg(
        ratio(prob & pos & found, prob & pos).alias("recall"), ratio(prob & pos & found, prob & found & F.col("truth").isin("positive", "negative")).alias("precision"), ratio(stress & pos & found, stress & pos).alias("stress_recall"),
        F.count_if(stress & pos).alias("stress_positives"), F.count_if(found).alias("found"), F.count_if(pos).alias("positives"), F.count_if(coded).alias("coded"), ratio(coded & F.col("code_hit"), coded).alias("code_recall"),
    )


def _gates(measures: DataFrame, *more: str) -> DataFrame:
    return evaluate.gates(measures).select(*r6("recall", *more, "precision", "stress_recall"), "stress_positives", *r6("workload"), "coded", *r6("code_recall"), "e1", "e2", "e3", "c1")


@query(
    """SELECT label, count(*) FILTER (found_any) matched, count(*) total, round(count(*) FILTER (found_any)::DOUBLE / count(*), 6) AS share FROM (SELECT reference_code label, found_any FROM par) GROUP BY 1""",
    "par",
)
def q_positive_coverage(spark, d):
    return evaluate.coverage(paragraphs(spark, d).withColumnRenamed("reference_code", "label"), "label", "found_any").select("label", "matched", "total", *r6("share"))


@query(
    """SELECT ref_id, CASE WHEN truth = 'excluded' THEN 'excluded' WHEN truth = 'positive' AND found_any THEN 'TP' WHEN truth = 'positive' THEN 'FN' WHEN found_any THEN 'FP' ELSE 'TN' END outcome FROM par""", "par"
)
def q_outcome_labels(spark, d):
    return paragraphs(spark, d).select("ref_id", scalars.outcome("truth", "found_any").alias("outcome"))


# the same measures of paragraphs matched by their texts, which SQL cannot express


@query()
def q_matched_confusion(spark, d):
    return _confusion_overall(matched_paragraphs(spark, d))


@query()
def q_matched_confusion_by_stratum(spark, d):
    return _rated(evaluate.confusion_rollup(matched_paragraphs(spark, d), "found_any", "stratum"), "stratum")


@query()
def q_matched_confusion_page(spark, d):
    return _rated(evaluate.page_confusion(matched_paragraphs(spark, d), "found_any", ["doc_id", "page"]))


@query()
def q_matched_coverage(spark, d):
    return evaluate.coverage(matched_paragraphs(spark, d).withColumnRenamed("reference_code", "label"), "label", "found_any").select("label", "matched", "total", *r6("share"))


@query()
def q_matched_outcomes(spark, d):
    return matched_paragraphs(spark, d).select("ref_id", scalars.outcome("truth", "found_any").alias("outcome"))


@query()
def q_matched_gates(spark, d):
    """E1 with the lower bound of the document bootstrap, E3 with the statements left after matching both providers, on pages of the reference."""
    par = materialize(matched_paragraphs(spark, d), "paragraphs")
    totals = evaluate.cluster_totals(par.where("stratum = 'probability'"), "found_any", "doc_id")
    low = inference.bootstrap_confusion(materialize(totals, "totals"), "doc_id", 2000, "b1").select("recall_low")
    # cuts, as the driver plans the whole anew after every stage
    low = materialize(low, "low")
    a, b, e = _edges(spark, d, MATCH, True, pages=par.select("doc_id", "page").distinct())
    left = assign.overlap_summary(a, b, assign.assign(materialize(e, "edges"), ["doc_id", "page"]), "statement_id", "statement_id", "code1").select("workload")
    m = _gate_measures(par).join(low, F.lit(True)).join(left, F.lit(True))
    return _gates(m.withColumn("workload", F.try_divide(F.col("workload").cast("double"), F.col("positives"))), "recall_low")


#: Score from which a statement counts as close to a paragraph in the queries that screen pages (a match needs MATCH).
SCREEN = 0.08


def _screened(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    st, texts, found = paragraph_edges(spark, sf_dir, SCREEN)
    return st, texts, materialize(found.withColumn("field", F.when(F.col("field_order") == 0, "quote").otherwise("quote_en")), "edges")


@query(f"SELECT statement_id, par, round(score, 6) score, method, field FROM sp WHERE score >= {SCREEN}", "sp")
def q_statement_paragraph(spark, d):
    """Every statement and paragraph of one page that are close, with score, method and the field that gave it."""
    return _screened(spark, d)[2].select(F.col("l").alias("statement_id"), F.col("r").alias("par"), *r6("score"), "method", "field")


BEST_PARAGRAPH = f", best AS (SELECT statement_id, arg_max(par, (score, -par)) par, max(score) score, arg_max(method, (score, -par)) AS method FROM sp WHERE score >= {SCREEN} GROUP BY 1)"


@query(BEST_PARAGRAPH + " SELECT statement_id, par, round(score, 6) score, method FROM best", "sp")
def q_greedy_paragraph(spark, d):
    """For every statement its closest paragraph (ties: the first listed); several may share one."""
    return textmatch.greedy(_screened(spark, d)[2]).select(F.col("l").alias("statement_id"), F.col("r").alias("par"), *r6("score"), "method")


@query(f", e AS (SELECT par, max(score) score, min(statement_id) FILTER (score = top) statement_id, count(*) n FROM (SELECT *, max(score) OVER (PARTITION BY par) top FROM sp WHERE score >= {SCREEN}) GROUP BY 1) SELECT p.par, coalesce(n, 0) n, round(coalesce(score, 0e0), 6) best_score, statement_id best_statement FROM par0 p LEFT JOIN e USING (par)", "sp")
def q_paragraph_best(spark, d):
    """For every paragraph how many statements are close, the best score and whose it is (ties: the smaller id)."""
    _, texts, found = _screened(spark, d)
    place = F.row_number().over(Window.partitionBy("r").orderBy(F.desc("score"), "l"))
    best = found.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("r"))).withColumn("i", place).where("i = 1")
    best = best.select(F.col("r").alias("par"), "n", "score", F.col("l").alias("best_statement"))
    return texts.select("par").join(best, "par", "left").select("par", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.round(F.coalesce("score", F.lit(0.0)), 6).alias("best_score"), "best_statement")


METHODS = {"whole_paragraph_equal": ("raw_equal", "normalized_equal"), "span_containment_matches": ("raw_equal", "normalized_equal", "raw_contains", "normalized_contains", "normalized_container"), "fuzzy_matches": ("fuzzy_token", "fuzzy_character")}


@query(
    BEST_PARAGRAPH + ", r AS (SELECT unnest(CASE qc_status WHEN 'pass' THEN ['all', 'kept'] ELSE ['all'] END) candidates, b.method, p.truth FROM onp LEFT JOIN best b USING (statement_id) LEFT JOIN par0 p USING (par)) "
    "SELECT candidates, count(*) on_pages, count(method) assigned, count(*) - count(method) unassigned, " + ", ".join(f"count(*) FILTER (truth = '{t}') assigned_{t}" for t in ("positive", "negative", "excluded")) + ", "
    + ", ".join(f"count(*) FILTER (method IN {m}) {n}" for n, m in METHODS.items()) + " FROM r GROUP BY 1",
    "sp",
)
def q_candidate_summary(spark, d):
    """Statements on pages of the reference, all of them and those that passed: how many are close to which paragraphs, and by which methods."""
    st, texts, found = _screened(spark, d)
    best = textmatch.greedy(found).select(F.col("l").alias("statement_id"), F.col("r").alias("par"), "method").join(texts.select("par", "truth"), "par")
    rows = st.select("statement_id", F.explode(F.when(F.col("qc_status") == "pass", F.array(F.lit("all"), F.lit("kept"))).otherwise(F.array(F.lit("all")))).alias("candidates")).join(best, "statement_id", "left")
    return evaluate.candidate_summary(rows, ["candidates"], METHODS)


@query(BEST_PARAGRAPH + ", f AS (SELECT p.stratum, p.truth, b.par IS NOT NULL p FROM par0 p LEFT JOIN (SELECT DISTINCT par FROM best) b USING (par)), k AS (SELECT stratum, " + CONFUSION.format(p="p") + f" FROM f WHERE stratum IS NOT NULL GROUP BY ROLLUP (stratum)) SELECT *, {RATES} FROM k", "sp")
def q_screen_confusion(spark, d):
    """Confusion by stratum where a paragraph counts as found if it is the closest one of some statement."""
    st, texts, found = _screened(spark, d)
    hit = textmatch.greedy(found).select(F.col("r").alias("par")).distinct().withColumn("p", F.lit(True))
    strata = read(spark, d, "reference_paragraphs").select(F.col("ref_id").alias("par"), "stratum")
    rows = texts.join(strata, "par").join(hit, "par", "left").select("stratum", "truth", F.coalesce("p", F.lit(False)).alias("p"))
    return _rated(evaluate.confusion_rollup(rows, "p", "stratum"), "stratum")


@query()
def q_alignment(spark, d):
    """Statements on pages of the reference by the truth of the paragraph they are assigned to, of each provider and of both."""
    rows = assigned_statements(spark, d).select(F.explode(F.array("provider", F.lit("any"))).alias("who"), "truth")
    return evaluate.alignment(rows, by=["who"]).select("who", "assigned_positive", "assigned_negative", "assigned_excluded", "unassigned", *r6("conservative_precision"))


# --- reliability and survey ---------------------------------------------------------------------------

PAIRS = {"inclusion": "inclusion_decision", "code": "final_code1", "family": "family", "odr": "final_odr", "direction": "privacy_direction", "relation": "privacy_relation", "strength": "strength"}
RELIABILITY = " UNION ALL ".join(
    f"SELECT '{m}' measure, {c}_martin::VARCHAR l, {c}_dominik::VARCHAR r, survey_weight w FROM rv" + ("" if m == "inclusion" else " WHERE inclusion_decision_martin = 'keep' AND inclusion_decision_dominik = 'keep'") for m, c in PAIRS.items()
)


@query(
    ", pr AS (" + RELIABILITY + """), k AS (SELECT * FROM pr WHERE l <> '' AND r <> ''), a AS (SELECT measure, count(*) n, count(*) FILTER (l = r) agree, sum(w) FILTER (l = r) / sum(w) wa FROM k GROUP BY 1),
    miss AS (SELECT measure, count(*) FILTER (NOT coalesce(l <> '' AND r <> '', false)) missing FROM pr GROUP BY 1),
    c AS (SELECT measure, v, count(*)::DOUBLE c FROM (SELECT measure, l v FROM k UNION ALL SELECT measure, r FROM k) GROUP BY 1, 2), s AS (SELECT measure, count(*) kk, sum(c * (c - 1)) cc, sum(c * c) c2 FROM c GROUP BY 1),
    j AS (SELECT *, agree::DOUBLE / n p, 2e0 * n n2, (1 - c2 / (4e0 * n * n)) / (kk - 1) ch FROM a JOIN s USING (measure) JOIN miss USING (measure))
    SELECT measure, n, missing, agree, round(p, 6) agreement, round(wa, 6) weighted_agreement, round(1 - (1 - p) / (1 - cc / (n2 * (n2 - 1))), 6) alpha, round((p - ch) / (1 - ch), 6) ac1 FROM j""",
    "rev",
)
def q_reliability_alpha_ac1(spark, d):
    keep = F.expr("inclusion_decision_martin = 'keep' and inclusion_decision_dominik = 'keep'")
    pairs = [F.struct(F.lit(m).alias("measure"), F.col(f"{c}_martin").cast("string").alias("l"), F.col(f"{c}_dominik").cast("string").alias("r"), F.lit(m == "inclusion").alias("all")) for m, c in PAIRS.items()]
    rows = reviews(spark, d).select("survey_weight", keep.alias("both"), F.explode(F.array(*pairs)).alias("p")).where("p.all or both").select("survey_weight", "p.*")
    out = reliability.two_raters(rows, "l", "r", "survey_weight", by=["measure"])
    return out.select("measure", "n", "missing", "agree", *r6("agreement", "weighted_agreement", "alpha", "ac1"))


REVIEWERS = ("martin", "dominik")
VALUES = (*REVIEWERS, "mid", "low", "high")


@query(", l AS (" + " UNION ALL ".join(f"SELECT '{v}' v, {v} x, survey_weight w FROM rev" for v in VALUES) + ") SELECT v measure, round(avg(x), 6) plain, round(sum(x * w) FILTER (x IS NOT NULL AND w IS NOT NULL) / sum(w) FILTER (x IS NOT NULL), 6) weighted FROM l GROUP BY 1", "rev")
def q_weighted_mean(spark, d):
    long_ = _values(spark, d)
    return long_.groupBy("measure").agg(F.round(F.avg("x"), 6).alias("plain"), F.round(survey.weighted_mean(F.col("x"), F.col("w")), 6).alias("weighted"))


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """measure, x, w, sample_stratum: the decision of each reviewer, their midpoint and its bounds."""
    five = F.explode(F.array(*[F.struct(F.lit(v).alias("measure"), F.col(v).alias("x"), F.col("survey_weight").alias("w"), F.col("sample_stratum").alias("sample_stratum")) for v in VALUES])).alias("s")
    return reviews(spark, sf_dir).select(five).select("s.*")


LONG = ", l AS (" + " UNION ALL ".join(f"SELECT '{v}' measure, {v} x, survey_weight w, sample_stratum stratum FROM rev" for v in VALUES) + ")"
STAGE = LONG + ", g AS (SELECT measure, stratum, count(*) n, avg(x) mean, coalesce(var_samp(x), 25e-2) v FROM l WHERE x IS NOT NULL GROUP BY 1, 2), h AS (SELECT measure, stratum, population, n, mean, v FROM des JOIN g USING (stratum))"


@query(STAGE + " SELECT measure, stratum, population, n, round(mean, 6) mean, round(v, 6) variance FROM h", "rev", "des")
def q_stratum_detail(spark, d):
    return survey.stratum_detail(_values(spark, d), "x", "sample_stratum", design(spark, d), by=["measure"]).select("measure", "stratum", "population", "n", *r6("mean", "variance"))


@query(
    STAGE + """, e AS (SELECT measure, sum(population / (SELECT sum(population)::DOUBLE FROM des) * mean) est, sqrt(greatest(0e0, sum((population / (SELECT sum(population)::DOUBLE FROM des)) ** 2 * (1 - n / population::DOUBLE) * v / n))) se FROM h GROUP BY 1)
    SELECT measure, round(est, 6) estimate, round(se, 6) standard_error, round(greatest(0e0, est - 1.959963984540054 * se), 6) low, round(least(1e0, est + 1.959963984540054 * se), 6) high FROM e""",
    "rev", "des",
)
def q_stratified_estimate(spark, d):
    return survey.stratified(_values(spark, d), "x", "sample_stratum", design(spark, d), by=["measure"]).select("measure", *r6("estimate", "standard_error", "low", "high"))


@query(
    LONG + """, g AS (SELECT measure reviewer, stratum, count(*) FILTER (x = 1)::DOUBLE k, count(x)::DOUBLE n FROM l WHERE measure IN ('martin', 'dominik') GROUP BY 1, 2), z AS (SELECT 1.959963984540054::DOUBLE z)
    SELECT reviewer, stratum, k::BIGINT successes, n::BIGINT trials, round((k / nullif(n, 0) + z * z / 2 / nullif(n, 0) - z * sqrt(k / nullif(n, 0) * (1 - k / nullif(n, 0)) / nullif(n, 0) + z * z / 4 / nullif(n, 0) / n)) / (1 + z * z / nullif(n, 0)), 6) low,
    round((k / nullif(n, 0) + z * z / 2 / nullif(n, 0) + z * sqrt(k / nullif(n, 0) * (1 - k / nullif(n, 0)) / nullif(n, 0) + z * z / 4 / nullif(n, 0) / n)) / (1 + z * z / nullif(n, 0)), 6) high FROM g, z""",
    "rev",
)
def q_wilson(spark, d):
    g = _values(spark, d).where(F.col("measure").isin(*REVIEWERS)).groupBy(F.col("measure").alias("reviewer"), F.col("sample_stratum").alias("stratum")).agg(F.count_if(F.col("x") == 1).alias("successes"), F.count("x").alias("trials"))
    low, high = scalars.wilson(F.col("successes"), F.col("trials"))
    return g.select("reviewer", "stratum", "successes", "trials", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(
    """, r AS (SELECT candidate_id, language, origin_type, row_number() OVER (PARTITION BY language, origin_type ORDER BY sha256('s1|' || candidate_id), candidate_id) k, count(*) OVER (PARTITION BY language, origin_type) n FROM cand)
    SELECT candidate_id, language, origin_type, n stratum_size, greatest(1, ceil(n * 5e-2))::BIGINT stratum_sample, round(greatest(1, ceil(n * 5e-2)) / n, 6) inclusion_probability, round(n / greatest(1, ceil(n * 5e-2)), 6) weight
    FROM r WHERE k <= greatest(1, ceil(n * 5e-2))""",
    "cand",
)
def q_stratified_sample(spark, d):
    rows = candidates(spark, d).select("candidate_id", "language", "origin_type")
    return survey.hash_sample(rows, "candidate_id", ["language", "origin_type"], 0.05, "s1").select("candidate_id", "language", "origin_type", "stratum_size", "stratum_sample", *r6("inclusion_probability", "weight"))


@query(
    """, p AS (SELECT count(*)::DOUBLE big, 1.96 * 1.96 * 25e-2 / 0.0025 n0 FROM cand), q AS (SELECT big, ceil(n0 / (1 + (n0 - 1) / big)) n FROM p)
    SELECT big::BIGINT population, n::BIGINT AS size, round(1.96 * sqrt(25e-2 / n * (big - n) / (big - 1)), 6) achieved FROM q""",
    "cand",
)
def q_sample_size(spark, d):
    n = candidates(spark, d).count()
    size, achieved = survey.sample_size(n, z=1.96)
    return spark.createDataFrame([(n, size, round(achieved, 6))], "population long, size long, achieved double")


DOUBLE_CODED = list(PAIRS.values())


@query("SELECT * FROM (SELECT candidate_id, " + ", ".join(f"{c}_martin IS DISTINCT FROM {c}_dominik {c}_differs" for c in DOUBLE_CODED) + ", concat_ws(';', " + ", ".join(f"CASE WHEN {c}_differs THEN '{c}' END" for c in DOUBLE_CODED) + ") fields FROM reviewed_candidates) WHERE fields <> ''")
def q_adjudication_queue(spark, d):
    """Candidates on which the reviewers differ in any of the double-coded fields, and in which."""
    rows = read(spark, d, "reviewed_candidates").select("candidate_id", *[(~F.col(f"{c}_martin").eqNullSafe(F.col(f"{c}_dominik"))).alias(f"{c}_differs") for c in DOUBLE_CODED])
    fields = F.concat_ws(";", *[F.when(F.col(f"{c}_differs"), c) for c in DOUBLE_CODED])
    return rows.withColumn("fields", fields).where("fields <> ''")


@query('SELECT inclusion_decision_martin AS "old", inclusion_decision_dominik AS "new", count(*) n FROM reviewed_candidates GROUP BY 1, 2')
def q_transition_counts(spark, d):
    raw = read(spark, d, "reviewed_candidates")
    return flatten.change_log(raw.select("candidate_id", F.col("inclusion_decision_martin").alias("v")), raw.select("candidate_id", F.col("inclusion_decision_dominik").alias("v")), ["candidate_id"], "v")


# --- inference ----------------------------------------------------------------------------------------

CONDITIONS = ("pages", "bytes", "included", "retail")
MEASURES = {"vocabulary": "family_share", "posture": "posture"}
ENT = "ent AS (SELECT string_split(doc_id, '_')[1] entity, avg(pages) pages, avg(bytes) bytes, avg(included::DOUBLE) included, avg((scope = 'retail_or_general')::DOUBLE) retail FROM (SELECT DISTINCT * FROM corpus_manifest) GROUP BY 1)"


@query(
    ", " + ENTITY + ", " + ENT + ", l AS ("
    + " UNION ALL ".join(f"SELECT variant, '{m}' measure, '{c}' AS condition, {x} x, {c} y FROM es LEFT JOIN ent USING (entity) WHERE entity NOT IN ('XE')" for m, x in MEASURES.items() for c in CONDITIONS)
    + """ UNION ALL SELECT variant, 'relation', 'vocabulary', posture, family_share FROM es WHERE entity NOT IN ('XE')) SELECT variant, measure, condition, count(*) n, round(CASE WHEN var_pop(x) > 1e-30 AND var_pop(y) > 1e-30 THEN covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) END, 6) r FROM l WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2, 3""",
    "alloc",
)
def q_macro_corr(spark, d):
    rows = _conditions(spark, d)
    return rows.where("x is not null and y is not null").groupBy("variant", "measure", "condition").agg(F.count(F.lit(1)).alias("n"), F.round(inference.correlation("x", "y"), 6).alias("r"))


def _conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """variant, entity, measure, x, condition, y: each measure against each condition, and one measure against the other; composites left out."""
    single = _entities(spark, sf_dir).where(~F.col("entity").isin(*COMPOSITE)).select("variant", "entity", *MEASURES.values())
    both = single.join(entities(spark, sf_dir), "entity", "left")
    test = lambda m, c, x, y: F.struct(F.lit(m).alias("measure"), F.lit(c).alias("condition"), F.col(x).alias("x"), F.col(y).alias("y"))
    grid = [test(m, c, x, c) for m, x in MEASURES.items() for c in CONDITIONS] + [test("relation", "vocabulary", "posture", "family_share")]
    return both.select("variant", "entity", F.explode(F.array(*grid)).alias("s")).select("variant", "entity", "s.*")


IDX = "(('0x' || substr(md5('b1|' || draw::VARCHAR || '|' || slot::VARCHAR), 1, 12))::BIGINT % k)"


@query(
    """, t AS (SELECT doc_id, count(*) FILTER (truth = 'positive' AND found_any) tp, count(*) FILTER (truth = 'negative' AND found_any) fp, count(*) FILTER (truth = 'positive' AND NOT found_any) fn FROM par WHERE stratum = 'probability' GROUP BY 1),
    n AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 i, count(*) OVER () k FROM t), d AS (SELECT draw, slot, k FROM range(2000) a(draw), (SELECT i slot, k FROM n)),
    s AS (SELECT draw, sum(tp) tp, sum(fp) fp, sum(fn) fn FROM (SELECT draw, """ + IDX + """ i FROM d) JOIN n USING (i) GROUP BY 1),
    m AS (SELECT tp / nullif(tp + fp, 0)::DOUBLE p, tp / nullif(tp + fn, 0)::DOUBLE r, coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0) f FROM s)
    SELECT round(quantile_cont(p, 0.025), 6) precision_low, round(quantile_cont(p, 0.975), 6) precision_high, round(quantile_cont(r, 0.025), 6) recall_low, round(quantile_cont(r, 0.975), 6) recall_high,
    round(quantile_cont(f, 0.025), 6) f1_low, round(quantile_cont(f, 0.975), 6) f1_high FROM m""",
    "par",
)
def q_bootstrap_confusion(spark, d):
    totals = evaluate.cluster_totals(paragraphs(spark, d).where("stratum = 'probability'"), "found_any", "doc_id")
    out = inference.bootstrap_confusion(materialize(totals, "totals"), "doc_id", 2000, "b1")
    return out.select(*r6(*out.columns))


@query()
def q_matched_bootstrap(spark, d):
    totals = evaluate.cluster_totals(matched_paragraphs(spark, d).where("stratum = 'probability'"), "found_any", "doc_id")
    out = inference.bootstrap_confusion(materialize(totals, "totals"), "doc_id", 2000, "b1")
    return out.select(*r6(*out.columns))


@query()
def q_bootstrap_poisson(spark, d):
    totals = evaluate.cluster_totals(matched_paragraphs(spark, d), "found_any", "doc_id")
    out = inference.bootstrap_confusion(totals, "doc_id", 2000, "b2", poisson=True)
    return out.select(*r6(*out.columns))


@query(
    ", " + ENTITY + """, ent AS (SELECT string_split(doc_id, '_')[1] entity, avg(pages) pages FROM (SELECT DISTINCT * FROM corpus_manifest) GROUP BY 1), t AS (SELECT entity k, posture x, pages y FROM es JOIN ent USING (entity) WHERE entity NOT IN ('XE') AND variant = 'ensemble' AND posture IS NOT NULL AND pages IS NOT NULL),
    n AS (SELECT *, row_number() OVER (ORDER BY k) i FROM t), s AS (SELECT draw, k, row_number() OVER (PARTITION BY draw ORDER BY md5('p1|' || draw::VARCHAR || '|' || k), k) i FROM range(10000) a(draw), t),
    e AS (SELECT draw, corr(n.x, t.y) r FROM s JOIN n ON s.i = n.i JOIN t ON s.k = t.k GROUP BY 1), o AS (SELECT corr(x, y) r0, count(*) n FROM t)
    SELECT round(r0, 6) r, n, round((count(*) FILTER (abs(e.r) >= abs(r0) - 1e-12) + 1) / 10001e0, 6) p FROM o, e GROUP BY r0, n""",
    "alloc",
)
def q_permutation_p(spark, d):
    rows = materialize(_conditions(spark, d).where("variant = 'ensemble' and measure = 'posture' and condition = 'pages'"), "tests")
    return inference.permutation_test(rows, "entity", "x", "y", 10_000, "p1").select(*r6("r"), "n", *r6("p"))


@query(
    LONG + """, g AS (SELECT measure reviewer, split_part(stratum, '|', 2) origin, split_part(stratum, '|', 1) AS language, round(1 - avg(x), 6) p FROM l WHERE x IS NOT NULL AND measure IN ('martin', 'dominik') GROUP BY 1, 2, 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY reviewer, origin ORDER BY p, language) i, count(*) OVER (PARTITION BY reviewer, origin) m FROM g)
    SELECT reviewer, origin, language, p, round(max(least(1e0, (m - i + 1) * p)) OVER (PARTITION BY reviewer, origin ORDER BY i), 6) p_holm FROM r""",
    "rev",
)
def q_holm(spark, d):
    parts = F.split("sample_stratum", r"\|")
    rows = _values(spark, d).where(F.col("measure").isin(*REVIEWERS) & F.col("x").isNotNull())
    g = rows.groupBy(F.col("measure").alias("reviewer"), parts[1].alias("origin"), parts[0].alias("language")).agg(F.round(1 - F.avg("x"), 6).alias("p"))
    return inference.holm(g, ["reviewer", "origin"], "p", ["language"]).select("reviewer", "origin", "language", "p", *r6("p_holm"))


@query()
def q_exact_inference(spark, d):
    """Every test of the grid; the correction is over the tests of the ensemble's measures against conditions, which are one family."""
    rows = _conditions(spark, d).withColumn("seed", F.concat_ws("|", "variant", "measure", "condition"))
    out = materialize(inference.exact_inference(rows, ["variant", "measure", "condition"], "x", "y", "seed", 10_000), "tests")
    family = (F.col("variant") == "ensemble") & (F.col("measure") != "relation")
    corrected = inference.holm(out.where(family), ["variant"], "p", ["measure", "condition"])
    return corrected.unionByName(out.where(~family), allowMissingColumns=True)


@query()
def q_cluster_bootstrap(spark, d):
    rows = _entities(spark, d).select("variant", "entity", "posture").where("posture is not null")
    return inference.cluster_bootstrap(rows, "entity", lambda pdf: pdf.posture.mean(), 2000, 20260821)


STAGES = {"extracted": "active", "pending": "active", "failed": "paused"}


@query("SELECT CASE prior_extraction_status WHEN 'extracted' THEN 'active' WHEN 'pending' THEN 'active' WHEN 'failed' THEN 'paused' END stage, prior_extraction_status status, count(DISTINCT doc_id) documents FROM corpus_manifest GROUP BY 1, 2")
def q_stage_map(spark, d):
    stages = F.broadcast(spark.createDataFrame(list(STAGES.items()), "status string, stage string"))
    rows = read(spark, d, "corpus_manifest").select("doc_id", F.col("prior_extraction_status").alias("status")).join(stages, "status", "left")
    return rows.groupBy("stage", "status").agg(F.count_distinct("doc_id").alias("documents"))


# --- text matching ------------------------------------------------------------------------------------


def _edges(spark: SparkSession, sf_dir: str, threshold: float, fuzzy: bool, only: list[str] | None = None, pages: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    st = quoted(spark, sf_dir).select("provider", "statement_id", "doc_id", "page", "quote", "quote_en", "code1")
    st = materialize(st if pages is None else st.join(pages, ["doc_id", "page"], "left_semi"), "sides")
    a, b = (st.where(F.col("provider") == p).drop("provider") for p in PROVIDERS)
    return a, b, textmatch.edges(a, b, ["doc_id", "page"], "statement_id", "statement_id", ["quote", "quote_en"], ["quote", "quote_en"], threshold, fuzzy, only=only)


@query(
    f""", s AS (SELECT statement_id, provider, doc_id, page, unnest([{CLEAN.format(c="quote")}, {CLEAN.format(c="quote_en")}]) t FROM st), p AS (SELECT a.statement_id l, b.statement_id r,
    min(CASE WHEN trim(a.t, ' ') = trim(b.t, ' ') THEN 0 ELSE 1 END) k FROM s a JOIN s b USING (doc_id, page) WHERE a.provider = 'openai' AND b.provider = 'claude' AND contains(trim(b.t, ' '), trim(a.t, ' ')) GROUP BY 1, 2)
    SELECT l, r, 1e0 score FROM p""",
    "st",
)
def q_span_exact(spark, d):
    return _edges(spark, d, 1.0, False, ["raw_equal", "raw_contains"])[2].select("l", "r", "score")


@query(
    f""", s AS (SELECT statement_id, provider, doc_id, page, t, trim(t, ' ') tr, {norm_sql("t")} tn, f FROM (SELECT *, unnest([{CLEAN.format(c="quote")}, {CLEAN.format(c="quote_en")}]) t, unnest([0, 1]) f FROM st) WHERE t IS NOT NULL),
    p AS (SELECT a.doc_id, a.page, a.statement_id l, b.statement_id r, a.f * 2 + b.f o, CASE WHEN a.tr = '' OR b.tr = '' THEN NULL WHEN a.tr = b.tr THEN 'raw_equal' WHEN contains(b.tr, a.tr) THEN 'raw_contains' WHEN least(length(a.tn), length(b.tn)) < 12 THEN NULL
      WHEN a.tn = b.tn THEN 'normalized_equal' WHEN contains(b.tn, a.tn) THEN 'normalized_contains' WHEN contains(a.tn, b.tn) THEN 'normalized_container' END m
      FROM s a JOIN s b USING (doc_id, page) WHERE a.provider = 'openai' AND b.provider = 'claude')
    SELECT doc_id, page::BIGINT page, l, r, 1e0 score, arg_min(m, o) AS method FROM p WHERE m IS NOT NULL GROUP BY 1, 2, 3, 4""",
    "st",
)
def q_span_normalized(spark, d):
    return _edges(spark, d, 1.0, False)[2].select("doc_id", *big("page"), "l", "r", "score", "method")


@query("SELECT doc_id, page, l, r, round(score, 6) score, method FROM xp", "xp")
def q_span_fuzzy(spark, d):
    return _edges(spark, d, 0.8, True)[2].select("doc_id", *big("page"), "l", "r", *r6("score"), "method")


@query("SELECT l, min(r) FILTER (score = top) r, round(max(score), 6) score, arg_min(method, r) FILTER (score = top) AS method FROM (SELECT *, max(score) OVER (PARTITION BY l) top FROM xp) GROUP BY 1", "xp")
def q_greedy_match(spark, d):
    return textmatch.greedy(_edges(spark, d, 0.8, True)[2]).select("l", "r", *r6("score"), "method")


@query()
def q_one_to_one(spark, d):
    a, _, e = _edges(spark, d, 0.8, True)
    e = materialize(e, "edges")
    return assign.records(a, "statement_id", assign.assign(e, ["doc_id", "page"]), e, ["doc_id", "page", "code1"])


@query()
def q_cross_overlap(spark, d):
    a, b, e = _edges(spark, d, 0.8, True)
    return assign.overlap_summary(a, b, assign.assign(e, ["doc_id", "page"]), "statement_id", "statement_id", "code1")


@query()
def q_candidate_union(spark, d):
    """Candidates made of matched statements of both providers and of what is left of each."""
    a, b, e = _edges(spark, d, 0.8, True)
    pairs = assign.assign(e, ["doc_id", "page"]).select("l", "r")
    both = a.select(F.col("statement_id").alias("l")).join(pairs, "l", "left").join(b.select(F.col("statement_id").alias("r")), "r", "full")
    origin = F.when(F.col("l").isNull(), "claude_only").when(F.col("r").isNull(), "openai_only").otherwise("both")
    return both.select(F.sha2(F.concat_ws("|", F.coalesce("l", F.lit("")), F.coalesce("r", F.lit(""))), 256).alias("candidate_id"), "l", "r", origin.alias("origin_type"))


@query(
    r""", s AS (SELECT source_mode <> 'text' rendered, regexp_replace(replace(quote, '-' || chr(10), ''), '\s+', '', 'g') q, regexp_replace(replace(coalesce(quote_en, ''), '-' || chr(10), ''), '\s+', '', 'g') src FROM st WHERE NOT regexp_matches(quote || coalesce(quote_en, ''), '[^\x00-\x7F]')),
    k AS (SELECT CASE WHEN q <> '' AND contains(src, q) THEN 's' WHEN coalesce(rendered, false) THEN 'r' ELSE 'u' END k FROM s), c AS (SELECT count(*) FILTER (k = 's') supported, count(*) FILTER (k = 'u') unsupported, count(*) FILTER (k = 'r') render_review FROM k)
    SELECT *, round(supported / nullif(supported + unsupported, 0)::DOUBLE, 6) fidelity, CASE WHEN render_review > 0 THEN 'pending_render_review' WHEN supported / (supported + unsupported)::DOUBLE >= 0.95 THEN 'pass' ELSE 'fail' END gate FROM c""",
    "st",
)
def q_span_fidelity(spark, d):
    """The part SQL can check: ASCII quotes against their translation. ``q_span_fidelity_all`` is the measure."""
    st = statements(spark, d).where("quote is not null").withColumn("src", F.coalesce("quote_en", F.lit(""))).where(~F.concat("quote", "src").rlike(r"[^\x00-\x7F]"))
    return evaluate.span_fidelity(st.withColumn("rendered", F.col("source_mode") != "text"), "quote", "src", "rendered").select("supported", "unsupported", "render_review", *r6("fidelity"), "gate")


@query()
def q_span_fidelity_all(spark, d):
    """All statements in all scripts against the texts of their page; without a quote or a text nothing is supported."""
    rows = quoted(spark, d).select("doc_id", "page", "quote", (F.col("source_mode") != "text").alias("rendered")).join(page_texts(spark, d), ["doc_id", "page"], "left")
    return evaluate.span_fidelity(rows, "quote", "source", "rendered").select("supported", "unsupported", "render_review", *r6("fidelity"), "gate")


# --- checks and manifests -----------------------------------------------------------------------------


@query("SELECT gold_id, paragraph_id, count(*) n FROM reference_paragraphs GROUP BY 1, 2 HAVING count(*) > 1")
def q_duplicate_keys(spark, d):
    return expectations.duplicates(read(spark, d, "reference_paragraphs"), ["gold_id", "paragraph_id"])


@query(
    """SELECT unnest([{'rule': 'code in codebook', 'n': count(*) FILTER (c.code IS NULL)}, {'rule': 'strength 1 to 3', 'n': count(*) FILTER (NOT coalesce(strength BETWEEN 1 AND 3, false))},
    {'rule': 'known direction', 'n': count(*) FILTER (NOT coalesce(privacy_direction IN ('increases', 'decreases', 'conditional', 'neutral'), false))}, {'rule': 'provider in id', 'n': count(*) FILTER (NOT coalesce(starts_with(statement_id, provider || ':'), false))}], recursive := true)
    FROM provider_outputs p LEFT JOIN codebook c ON c.code = p.code1"""
)
def q_expectations(spark, d):
    codes = read(spark, d, "codebook").select(F.col("code").alias("code1")).distinct().withColumn("known", F.lit(True))
    rows = read(spark, d, "provider_outputs").select("statement_id", "provider", "code1", "strength", "privacy_direction").join(codes, "code1", "left")
    rules = {"code in codebook": F.col("known"), "strength 1 to 3": F.col("strength").between(1, 3), "known direction": F.col("privacy_direction").isin("increases", "decreases", "conditional", "neutral"), "provider in id": F.col("statement_id").startswith(F.concat("provider", F.lit(":")))}
    return expectations.violations(rows, rules)


@query(
    """, c AS (SELECT candidate_id, 'openai' provider, openai_codes codes FROM cand UNION ALL SELECT candidate_id, 'claude', claude_codes FROM cand),
    a AS (SELECT candidate_id, provider, list_sort(list_distinct(list_filter(list_transform(string_split(codes, ';'), lambda x: trim(x)), lambda x: x <> ''))) m FROM c WHERE codes <> ''),
    b AS (SELECT candidate_id, ids.provider, list_sort(list(DISTINCT s.code1)) e FROM ids JOIN st s USING (statement_id) WHERE s.code1 IS NOT NULL GROUP BY 1, 2)
    SELECT candidate_id, provider FROM a JOIN b USING (candidate_id, provider) WHERE m <> e""",
    "st", "ids",
)
def q_code_set_mismatch(spark, d):
    cand = candidates(spark, d)
    sides = F.explode(F.array(*[F.struct(F.lit(p).alias("provider"), F.col(f"{p}_codes").alias("codes")) for p in PROVIDERS])).alias("s")
    listed = cand.select("candidate_id", sides).where("s.codes <> ''").select("candidate_id", "s.provider", F.array_sort(F.array_distinct(scalars.split_ids("s.codes"))).alias("m"))
    ids = flatten.candidate_statements(cand, {p: f"{p}_statement_ids" for p in PROVIDERS})
    attached = ids.join(statements(spark, d).select("statement_id", "code1"), "statement_id").groupBy("candidate_id", "provider").agg(F.array_sort(F.collect_set("code1")).alias("e")).where(F.size("e") > 0)
    return listed.join(attached, ["candidate_id", "provider"]).where("m <> e").select("candidate_id", "provider")


@query(
    """WITH n AS (SELECT doc_id, min(sha256) h FROM corpus_manifest WHERE included GROUP BY 1), o AS (SELECT source_manifest_doc_id doc_id, max(sha256) h FROM corpus_manifest GROUP BY 1)
    SELECT coalesce(o.doc_id, n.doc_id) path, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' ELSE 'changed' END status FROM o FULL JOIN n ON o.doc_id = n.doc_id WHERE o.h IS DISTINCT FROM n.h"""
)
def q_manifest_diff(spark, d):
    raw = read(spark, d, "corpus_manifest")
    new = raw.where("included").groupBy("doc_id").agg(F.min("sha256").alias("h"))
    old = raw.where("source_manifest_doc_id is not null").groupBy(F.col("source_manifest_doc_id").alias("doc_id")).agg(F.max("sha256").alias("h"))
    return expectations.manifest_diff(old, new, "doc_id", "h")


@query("SELECT statement_id, sha256(regexp_replace(coalesce(quote, ''), '\\r\\n?', chr(10), 'g')) digest, ('0x' || substr(sha256(statement_id), 1, 16))::UBIGINT::VARCHAR seed FROM st", "st")
def q_text_digest(spark, d):
    return statements(spark, d).select("statement_id", scalars.text_digest(F.coalesce("quote", F.lit(""))).alias("digest"), scalars.seed_of("statement_id").cast("string").alias("seed"))


@query("SELECT qc_status, provider, count(*) n, count(DISTINCT doc_id) documents, sum(length(coalesce(quote, '')))::BIGINT characters FROM provider_outputs GROUP BY 1, 2")
def q_value_counts(spark, d):
    return read(spark, d, "provider_outputs").groupBy("qc_status", "provider").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("documents"), F.sum(F.char_length(F.coalesce("quote", F.lit("")))).alias("characters"))


@query("SELECT scope, source_type, count(*) documents, sum(pages)::BIGINT pages, sum(bytes)::BIGINT AS bytes FROM (SELECT DISTINCT * FROM corpus_manifest) GROUP BY 1, 2")
def q_usage_rollup(spark, d):
    return read(spark, d, "corpus_manifest").distinct().groupBy("scope", "source_type").agg(F.count(F.lit(1)).alias("documents"), F.sum("pages").alias("pages"), F.sum("bytes").alias("bytes"))


def queries() -> dict:
    from attestra.plans import checks  # noqa: F401  registers its queries
    from attestra.streaming import ingest

    return QUERIES | {"q_events_hourly": partial(ingest.hourly_batch)}


def oracle_sql() -> dict[str, str]:
    from attestra.plans import checks  # noqa: F401  registers its queries
    from attestra.streaming import ingest

    return ORACLES | {"q_events_hourly": ingest.HOURLY_SQL}
