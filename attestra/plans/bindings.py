"""The views the general queries run on, in DataFrame and in SQL form.

``SQL`` holds the same views as common table expressions, so that every oracle starts
from the raw tables on its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions.scalars import annotation, entity_prefix
from attestra.operators import assign, flatten, textmatch
from attestra.tables import materialize, read

PROVIDERS = ("openai", "claude")
# Least score of a statement and a paragraph, or of two statements, that count as the same text.
MATCH = 0.8
# Words and signs standing for a missing quote.
PLACEHOLDERS = ("none", "null", "n/a", "-", "")


def statements(spark: SparkSession, sf_dir: str, pages: DataFrame | None = None) -> DataFrame:
    """One row per statement_id: the latest received, ties to the smaller record_id; of ``pages`` (doc_id, page) only, if given."""
    cols = ["statement_id", "record_id", "provider", "unit_id", "doc_id", "page", "quote", "quote_en", "code1", "odr", "privacy_direction", "privacy_relation", "strength", "source_mode", "qc_status"]
    raw = read(spark, sf_dir, "provider_outputs").where("statement_id is not null")
    order = F.struct(F.coalesce("received_at", F.lit("0001-01-01").cast("timestamp_ntz")).alias("at"), (-F.col("record_id")).alias("minus"))
    # the winner is found on three narrow columns; of its row only the columns a query uses are read and moved
    latest = raw.groupBy("statement_id").agg(F.max(order).alias("x")).select("statement_id", (-F.col("x.minus")).alias("record_id"))
    # whether a row is the latest of all does not depend on the pages, so they come first: few whole rows are moved then
    rows = raw.select(*cols) if pages is None else raw.select(*cols).join(pages, ["doc_id", "page"], "left_semi")
    return rows.join(latest, ["statement_id", "record_id"], "left_semi")


def quoted(spark: SparkSession, sf_dir: str, pages: DataFrame | None = None) -> DataFrame:
    """Statements with null for placeholders in quote and quote_en."""
    return statements(spark, sf_dir, pages).withColumns({c: F.when(F.lower(F.trim(c)).isin(*PLACEHOLDERS), None).otherwise(F.col(c)) for c in ("quote", "quote_en")})


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, source: all texts known of a page, kept apart by a sign no quote holds."""
    paragraphs = read(spark, sf_dir, "reference_paragraphs").select("doc_id", "page", "text")
    documents = read(spark, sf_dir, "documents").select(F.col("manifest_doc_id").alias("doc_id"), "page", "text")
    texts = paragraphs.union(documents).where("doc_id is not null and page is not null and text is not null").distinct()
    return texts.groupBy("doc_id", "page").agg(F.concat_ws("\x00", F.sort_array(F.collect_list("text"))).alias("source"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per candidate with clean categories."""
    raw = read(spark, sf_dir, "candidate_mapping")
    clean = {"origin_type": F.lower(F.trim("origin_type")), "language": F.lower(F.trim("language"))}
    kept = ["doc_id", "page", "openai_statement_ids", "claude_statement_ids", "openai_codes", "claude_codes"]
    return raw.groupBy("candidate_id").agg(*[F.max(c).alias(n) for n, c in clean.items()], *[F.max(c).alias(c) for c in kept])


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements attached to candidates, with codes of the codebook."""
    ids = flatten.candidate_statements(candidates(spark, sf_dir), {p: f"{p}_statement_ids" for p in PROVIDERS})
    codes = read(spark, sf_dir, "codebook").select(F.col("code").alias("code1")).distinct()
    st = statements(spark, sf_dir).drop("provider").join(codes, "code1", "left_semi")
    return ids.join(st, "statement_id").withColumnRenamed("code1", "code")


def pages_with(spark: SparkSession, sf_dir: str, provider: str) -> DataFrame:
    return read(spark, sf_dir, "provider_outputs").where(F.col("provider") == provider).groupBy("doc_id", "page").agg(F.min("code1").alias(f"code_{provider}"))


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference paragraphs with the truth and whether each provider has anything on their page, whatever its text: what SQL can check."""
    ref = read(spark, sf_dir, "reference_paragraphs").select("ref_id", "doc_id", "page", "stratum", F.col("reference_truth").alias("truth"), "reference_code")
    for p in PROVIDERS:
        ref = ref.join(pages_with(spark, sf_dir, p), ["doc_id", "page"], "left").withColumn(f"found_{p}", F.col(f"code_{p}").isNotNull())
    ref = ref.withColumn("found_any", F.col("found_openai") | F.col("found_claude")).withColumn("found_code", F.coalesce("code_openai", "code_claude"))
    return ref.withColumn("code_hit", F.col("reference_code") == F.col("found_code"))


def paragraph_edges(spark: SparkSession, sf_dir: str, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Statements on pages of the reference, its distinct paragraphs of a page (par: the first listing), and the edges between them that reach a score."""
    page = ["doc_id", "page"]
    ref = read(spark, sf_dir, "reference_paragraphs").select("ref_id", *page, "text", F.col("reference_truth").alias("truth"))
    texts = ref.where("text is not null").groupBy(*page, "text").agg(F.min("ref_id").alias("par"), F.coalesce(F.min_by("truth", "ref_id"), F.lit("")).alias("truth"))
    st = quoted(spark, sf_dir, ref.select(*page).distinct()).select("provider", "statement_id", *page, "quote", "quote_en", "code1", "qc_status")
    st = materialize(st, "statements")
    return st, texts, textmatch.edges(st, texts, page, "statement_id", "par", ["quote", "quote_en"], ["text"], threshold)


def assigned_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements on pages of the reference, each with the text of the paragraph it is assigned to.

    One to one per provider and page, by the texts; a paragraph listed twice is one paragraph. ``text`` and
    ``truth`` (that of the paragraph's first listing) are null for statements that got none.
    """
    page = ["doc_id", "page"]
    st, texts, found = paragraph_edges(spark, sf_dir, MATCH)
    # a cut: the assignment reads the edges twice, and the driver plans the whole anew after every stage
    found = materialize(found.join(st.select(F.col("statement_id").alias("l"), "provider"), "l"), "edges")
    pairs = assign.assign(found, ["provider", *page]).select(F.col("l").alias("statement_id"), F.col("r").alias("par"))
    return st.join(pairs, "statement_id", "left").join(texts.select("par", "text", "truth"), "par", "left").drop("par")


def matched_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference paragraphs with the truth and whether a statement of each provider is assigned to them; every listing of a paragraph gets the same answer."""
    ref = read(spark, sf_dir, "reference_paragraphs").select("ref_id", "doc_id", "page", "text", "stratum", F.col("reference_truth").alias("truth"), "reference_code")
    code = [F.max(F.when(F.col("provider") == p, F.struct(F.coalesce("code1", F.lit("")).alias("c"))))["c"].alias(f"code_{p}") for p in PROVIDERS]
    got = assigned_statements(spark, sf_dir).where("text is not null").groupBy("doc_id", "page", "text").agg(*code)
    ref = ref.join(got, ["doc_id", "page", "text"], "left").withColumns({f"found_{p}": F.col(f"code_{p}").isNotNull() for p in PROVIDERS})
    hit = F.coalesce(F.col("code_openai") == F.col("reference_code"), F.lit(False)) | F.coalesce(F.col("code_claude") == F.col("reference_code"), F.lit(False))
    return ref.drop("text").withColumn("found_any", F.col("found_openai") | F.col("found_claude")).withColumn("code_hit", hit)


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed candidates without the untranslated ones, decisions as 0 and 1."""
    raw = read(spark, sf_dir, "reviewed_candidates").where(~F.coalesce("exclude_untranslated", F.lit(False)))
    for r in ("martin", "dominik"):
        raw = raw.withColumn(r, F.when(F.col(f"inclusion_decision_{r}") == "keep", 1.0).when(F.col(f"inclusion_decision_{r}") == "exclude", 0.0))
    return raw.withColumns({"mid": (F.col("martin") + F.col("dominik")) / 2, "low": F.when(F.col("mid").isNotNull(), F.least("martin", "dominik")), "high": F.when(F.col("mid").isNotNull(), F.greatest("martin", "dominik"))})


def design(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = read(spark, sf_dir, "sampled_validation_freeze_manifest")
    return raw.select(F.concat_ws("|", "language", "origin_type").alias("stratum"), "population", "sample")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators per entity, from the source documents."""
    raw = read(spark, sf_dir, "corpus_manifest").distinct()
    return raw.groupBy(entity_prefix("doc_id").alias("entity")).agg(F.avg("pages").alias("pages"), F.avg("bytes").alias("bytes"), F.avg(F.col("included").cast("double")).alias("included"), F.avg((F.col("scope") == "retail_or_general").cast("double")).alias("retail"))


__all__ = ["annotation"]

def norm_sql(c: str) -> str:
    """The normalized text; SQL engines have no compatibility forms, so full-width letters and digits and ligatures are mapped by hand."""
    plain = "0123456789abcdefghijklmnopqrstuvwxyz"
    wide = "".join(chr(ord(x) + 0xFEE0) for x in plain)
    c = f"lower(nfc_normalize({c}))"
    for sign, letters in {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl"}.items():
        c = f"replace({c}, '{sign}', '{letters}')"
    return rf"trim(regexp_replace(translate({c}, '{wide}', '{plain}'), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


CLEAN = "CASE WHEN lower(trim({c})) IN ('none', 'null', 'n/a', '-', '') THEN NULL ELSE {c} END"


def runs_sql(items: str, pairs: str) -> str:
    """Longest common run of two lists (a, b) of each pair: equal items, grouped along the diagonals they follow each other on."""
    side = lambda c, n: f"SELECT pair, unnest({items.format(c=c)}) w, unnest(range(len({items.format(c=c)}))) {n} FROM {pairs}"
    met = f"SELECT x.pair, i, i - j d, i - row_number() OVER (PARTITION BY x.pair, i - j ORDER BY i) g FROM ({side('qn', 'i')}) x JOIN ({side('pn', 'j')}) y ON x.pair = y.pair AND x.w = y.w"
    return f"SELECT pair, max(n) run FROM (SELECT pair, count(*) n FROM ({met}) GROUP BY pair, d, g) GROUP BY 1"


def scores_sql(pairs: str, wanted: str = "true") -> str:
    """pair, score, method of a view of pairs with texts q and p: the match ladder; the fuzzy stages only for pairs that are ``wanted``."""
    return f"""t0 AS (SELECT *, trim(q, ' ') qr, trim(p, ' ') pr, {norm_sql('q')} qn, {norm_sql('p')} pn FROM {pairs}),
        t1 AS (SELECT *, CASE WHEN qr = '' OR pr = '' THEN 'none' WHEN qr = pr THEN 'raw_equal' WHEN contains(pr, qr) THEN 'raw_contains' WHEN least(length(qn), length(pn)) < 12 THEN 'none'
          WHEN qn = pn THEN 'normalized_equal' WHEN contains(pn, qn) THEN 'normalized_contains' WHEN contains(qn, pn) THEN 'normalized_container' END m FROM t0),
        t2 AS (SELECT * FROM t1 WHERE m IS NULL AND {wanted}), rt AS ({runs_sql("string_split({c}, ' ')", "t2")}), rc AS ({runs_sql("string_split(replace({c}, ' ', ''), '')", "t2")}),
        t3 AS (SELECT t1.*, least(len(string_split(qn, ' ')), len(string_split(pn, ' '))) nt, least(length(replace(qn, ' ', '')), length(replace(pn, ' ', ''))) nc, coalesce(rt.run, 0) kt, coalesce(rc.run, 0) kc
          FROM t1 LEFT JOIN rt USING (pair) LEFT JOIN rc USING (pair)),
        t4 AS (SELECT *, CASE WHEN nt >= 4 AND kt >= CASE WHEN nt <= 6 THEN 4 ELSE 6 END THEN kt::DOUBLE / nt ELSE 0e0 END st, CASE WHEN nc >= 20 AND kc >= 20 THEN kc::DOUBLE / nc ELSE 0e0 END sc FROM t3),
        scored AS (SELECT pair, CASE WHEN m = 'none' THEN 0e0 WHEN m IS NOT NULL THEN 1e0 ELSE greatest(st, sc) END score, CASE WHEN m IS NOT NULL THEN m WHEN sc > st THEN 'fuzzy_character' WHEN st > 0 THEN 'fuzzy_token' ELSE 'none' END AS method FROM t4)"""


# A run of most of a text holds most of its words; only texts of very few words are compared without sharing any.
SHARED = "(least(len(string_split(qn, ' ')), len(string_split(pn, ' '))) < 6 OR len(list_intersect(string_split(qn, ' '), string_split(pn, ' '))) >= 0.3 * least(len(list_distinct(string_split(qn, ' '))), len(list_distinct(string_split(pn, ' ')))))"


SQL = {
    "st": """st AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY coalesce(received_at, TIMESTAMP '0001-01-01') DESC, record_id) rn
        FROM provider_outputs WHERE statement_id IS NOT NULL) WHERE rn = 1)""",
    "cand": """cand AS (SELECT candidate_id, max(lower(trim(origin_type))) origin_type, max(lower(trim(language))) AS language, max(doc_id) doc_id, max(page) page,
        max(openai_statement_ids) openai_statement_ids, max(claude_statement_ids) claude_statement_ids, max(openai_codes) openai_codes, max(claude_codes) claude_codes
        FROM candidate_mapping GROUP BY candidate_id)""",
    "ids": """ids AS (SELECT DISTINCT candidate_id, provider, statement_id FROM (
        SELECT candidate_id, 'openai' provider, trim(unnest(string_split(openai_statement_ids, ';'))) statement_id FROM cand UNION ALL
        SELECT candidate_id, 'claude', trim(unnest(string_split(claude_statement_ids, ';'))) FROM cand) WHERE statement_id <> '')""",
    "ev": """ev AS (SELECT i.candidate_id, i.provider, i.statement_id, s.doc_id, s.page, s.quote, s.quote_en, s.code1 code, string_split(s.code1, '.')[1] AS family, s.odr,
        coalesce(nullif(s.privacy_direction, ''), 'neutral') direction, coalesce(nullif(s.privacy_relation, ''), 'not_applicable') relation,
        least(3, greatest(1, coalesce(s.strength, 1))) strength, coalesce(nullif(s.quote_en, ''), nullif(s.quote, ''), '') AS txt
        FROM ids i JOIN st s USING (statement_id) WHERE s.code1 IN (SELECT code FROM codebook))""",
    "cells": """cells AS (SELECT candidate_id, provider, code, family, odr, direction, relation, strength, arg_max(statement_id, (length(txt), sha256(txt))) statement_id,
        arg_max(txt, (length(txt), sha256(txt))) AS txt FROM ev GROUP BY ALL)""".replace("GROUP BY ALL", "GROUP BY candidate_id, provider, code, family, odr, direction, relation, strength"),
    "parts": """parts AS (SELECT *, 1e0 / count(DISTINCT code) OVER (PARTITION BY candidate_id, provider) / count(*) OVER (PARTITION BY candidate_id, provider, code) part FROM cells)""",
    "sides": """sides AS (SELECT candidate_id, count(*) present, count(DISTINCT codes) kinds FROM (
        SELECT candidate_id, provider, list_sort(list(DISTINCT code)) codes FROM cells GROUP BY 1, 2) GROUP BY 1)""",
    "alloc": """alloc AS (SELECT p.*, v.variant, p.part * v.share AS mass, c.doc_id, c.language, c.origin_type FROM parts p JOIN sides s USING (candidate_id) JOIN cand c USING (candidate_id),
        LATERAL (SELECT 'ensemble' variant, 1e0 / s.present AS share UNION ALL SELECT p.provider, 1e0 UNION ALL SELECT 'consensus', 5e-1 WHERE s.present = 2 AND s.kinds = 1) v)""",
    "par": """pg AS (SELECT doc_id, page, provider, min(code1) code FROM provider_outputs GROUP BY 1, 2, 3),
        par AS (SELECT r.ref_id, r.doc_id, r.page, r.stratum, r.reference_truth truth, r.reference_code, o.code code_openai, c.code code_claude, o.code IS NOT NULL found_openai,
        c.code IS NOT NULL found_claude, o.code IS NOT NULL OR c.code IS NOT NULL found_any, coalesce(o.code, c.code) found_code FROM reference_paragraphs r
        LEFT JOIN pg o ON o.doc_id = r.doc_id AND o.page = r.page AND o.provider = 'openai' LEFT JOIN pg c ON c.doc_id = r.doc_id AND c.page = r.page AND c.provider = 'claude')""",
    "sp": f"""par0 AS (SELECT doc_id, page, text, min(ref_id) par, coalesce(arg_min(reference_truth, ref_id), '') truth, arg_min(stratum, ref_id) stratum FROM reference_paragraphs WHERE text IS NOT NULL GROUP BY 1, 2, 3),
        onp AS (SELECT st.* FROM st SEMI JOIN (SELECT DISTINCT doc_id, page FROM reference_paragraphs) USING (doc_id, page)),
        f0 AS (SELECT statement_id, doc_id, page, unnest([{CLEAN.format(c='quote')}, {CLEAN.format(c='quote_en')}]) q, unnest([0, 1]) f FROM onp),
        f1 AS (SELECT statement_id, f, par, q, text p, dense_rank() OVER (ORDER BY q, text) pair FROM f0 JOIN par0 USING (doc_id, page) WHERE q IS NOT NULL), f2 AS (SELECT DISTINCT pair, q, p FROM f1),
        {scores_sql("f2")},
        sp AS (SELECT statement_id, par, max(score) score, arg_max(method, (score, -f)) AS method, CASE arg_max(f, (score, -f)) WHEN 0 THEN 'quote' ELSE 'quote_en' END field FROM f1 JOIN scored USING (pair) WHERE score > 0 GROUP BY 1, 2)""",
    "xp": f"""x0 AS (SELECT statement_id, provider, doc_id, page, unnest([{CLEAN.format(c='quote')}, {CLEAN.format(c='quote_en')}]) t, unnest([0, 1]) f FROM st),
        x1 AS (SELECT a.doc_id, a.page, a.statement_id l, b.statement_id r, a.f * 2 + b.f o, a.t q, b.t p, dense_rank() OVER (ORDER BY a.t, b.t) pair FROM x0 a JOIN x0 b USING (doc_id, page) WHERE a.provider = 'openai' AND b.provider = 'claude' AND a.t IS NOT NULL AND b.t IS NOT NULL),
        x2 AS (SELECT DISTINCT pair, q, p FROM x1), {scores_sql("x2", SHARED)},
        xp AS (SELECT doc_id, page::BIGINT page, l, r, max(score) score, arg_max(method, (score, -o)) AS method FROM x1 JOIN scored USING (pair) WHERE score >= 0.8 GROUP BY 1, 2, 3, 4)""",
    "rev": """rv AS (SELECT *, CASE inclusion_decision_martin WHEN 'keep' THEN 1e0 WHEN 'exclude' THEN 0e0 END martin, CASE inclusion_decision_dominik WHEN 'keep' THEN 1e0 WHEN 'exclude' THEN 0e0 END dominik
        FROM reviewed_candidates WHERE NOT coalesce(exclude_untranslated, false)),
        rev AS (SELECT *, (martin + dominik) / 2 AS mid, CASE WHEN martin + dominik IS NOT NULL THEN least(martin, dominik) END low, CASE WHEN martin + dominik IS NOT NULL THEN greatest(martin, dominik) END high FROM rv)""",
    "des": """des AS (SELECT language || '|' || origin_type stratum, population, sample FROM sampled_validation_freeze_manifest)""",
    "ent": """ent AS (SELECT string_split(doc_id, '_')[1] entity, avg(pages) pages, avg(bytes) bytes, avg(included::DOUBLE) included FROM (SELECT DISTINCT * FROM corpus_manifest) GROUP BY 1)""",
}


def sql(body: str, *views: str) -> str:
    needed = {"ids": ["cand", "ids"], "ev": ["st", "cand", "ids", "ev"], "cells": ["st", "cand", "ids", "ev", "cells"], "alloc": ["st", "cand", "ids", "ev", "cells", "parts", "sides", "alloc"], "sp": ["st", "sp"], "xp": ["st", "xp"]}
    names: list[str] = []
    for v in views:
        names += [x for x in needed.get(v, [v]) if x not in names]
    return ("WITH " + ",\n".join(SQL[n] for n in names) + "\n" if names else "") + body
