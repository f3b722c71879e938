"""Queries on sources, sinks and flags: what is written comes back, and small derived columns."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import functions as F

from attestra.functions import scalars
from attestra.operators import expectations, flatten
from attestra.plans.bindings import PROVIDERS, candidates, statements
from attestra.plans.catalogue import allocation, big, nested, query, r6
from attestra.sources import readers, sheets, writers
from attestra.tables import read, scratch, write_bytes

# --- what is written comes back -----------------------------------------------------------------------


@query(
    """SELECT provider || ':' || unit_id || ':S' || lpad(n::VARCHAR, 3, '0') statement_id, code1, sha256(coalesce(quote, '')) quote_hash
    FROM (SELECT *, row_number() OVER (PARTITION BY request_id, unit_id ORDER BY record_id) n FROM provider_outputs WHERE provider = 'openai')"""
)
def q_io_jsonl(spark, d):
    """Response documents written as JSON lines, read with their schema and flattened."""
    path = scratch(spark, "jsonl")
    nested(spark, d, "openai").write.json(path)
    rows = flatten.flatten(readers.read_jsonl(spark, path, flatten.RESPONSE_SCHEMA), "openai")
    return rows.select("statement_id", "code1", F.sha2(F.coalesce("quote", F.lit("")), 256).alias("quote_hash"))


MANIFEST = "doc_order long, doc_id string, filename string, pages int, included boolean, language string"


def _manifest_csv(spark, d, **options) -> str:
    path = scratch(spark, "csv")
    rows = read(spark, d, "corpus_manifest").select("doc_order", "doc_id", "filename", F.coalesce("pages", F.lit(0)).alias("pages"), "included", "language")
    writers.write_csv(rows, path, ["doc_order", "doc_id"], **options)
    return path


@query("SELECT doc_order, doc_id, filename, coalesce(pages, 0)::BIGINT pages, included, coalesce(language, '') AS language FROM corpus_manifest")
def q_io_csv_literal(spark, d):
    """A CSV export read back with every word as it stands: nulls were written as empty fields and stay empty texts."""
    return readers.read_csv_literal(spark, _manifest_csv(spark, d), MANIFEST).select("doc_order", "doc_id", "filename", *big("pages"), "included", "language")


@query(f"SELECT doc_order, doc_id, filename, coalesce(pages, 0)::BIGINT pages, included, CASE WHEN language IN {readers.MISSING} THEN NULL ELSE language END AS language FROM corpus_manifest")
def q_io_csv_missing(spark, d):
    """The same export, gzipped, read with the usual words for missing values as null."""
    return readers.read_csv_missing(spark, _manifest_csv(spark, d, gzip=True), MANIFEST).select("doc_order", "doc_id", "filename", *big("pages"), "included", "language")


@query("SELECT candidate_id, round(survey_weight, 6) survey_weight, sample_stratum FROM reviewed_candidates")
def q_io_csv_digits(spark, d):
    """Doubles exported with twelve significant digits."""
    path = scratch(spark, "digits")
    writers.write_csv(read(spark, d, "reviewed_candidates").select("candidate_id", "survey_weight", "sample_stratum"), path, ["candidate_id"], digits=12)
    return readers.read_csv_missing(spark, path, "candidate_id string, survey_weight double, sample_stratum string").select("candidate_id", *r6("survey_weight"), "sample_stratum")


@query("SELECT code, family, label FROM codebook")
def q_io_json(spark, d):
    """A table exported as JSON rows with sorted keys, put into one JSON document and read as such."""
    path, whole = scratch(spark, "rows"), scratch(spark, "json")
    writers.write_json(read(spark, d, "codebook"), path, ["code"])
    text = spark.read.text(path).agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list("value")), ","), F.lit("]")).alias("value"))  # 35 rows
    text.write.text(whole)
    return readers.read_json(spark, whole, "code string, family string, label string")


@query("SELECT code, family, label, length(code)::BIGINT size FROM codebook")
def q_io_excel(spark, d):
    """The codebook as a sheet of a workbook, with its header in the second row."""
    rows = read(spark, d, "codebook").select("code", "family", "label", F.char_length("code").alias("size")).orderBy("code").collect()  # 35 rows, fixed
    path = scratch(spark, "book") + "/codebook.xlsx"
    write_bytes(spark, path, sheets.workbook("codes", ["code", "family", "label", "size"], [list(r) for r in rows], above=1))
    return readers.read_excel(spark, path, "codes", 1, "code string, family string, label string, size long")


def png(width: int, height: int) -> bytes:
    """A grey picture."""
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress((b"\0" + b"\x80" * width) * height)) + part(b"IEND", b"")


@query("SELECT 'figure-' || lpad(n::VARCHAR, 2, '0') || '.png' AS name, 40 + n AS width, 30 + 2 * n AS height, 1 channels FROM range(6) t(n)")
def q_io_images(spark, d):
    """Sizes of pictures of a folder."""
    path = scratch(spark, "figures")
    for n in range(6):
        write_bytes(spark, f"{path}/figure-{n:02d}.png", png(40 + n, 30 + 2 * n))
    return readers.read_image_sizes(spark, path).select(F.substring_index("origin", "/", -1).alias("name"), *big("width", "height", "channels"))


@query("SELECT 'a/one.txt' path, sha256('one' || chr(10) || 'two' || chr(10)) digest, 'kept' AS status UNION ALL SELECT 'b/two.csv', sha256('x,y' || chr(10)), 'kept' UNION ALL SELECT 'b/three.bin', sha256('bin' || chr(13) || chr(10)), 'kept'")
def q_io_manifest(spark, d):
    """Digests of a tree (line ends of texts made uniform, one folder left out), written as a manifest, read back and compared with the files."""
    root, path = scratch(spark, "tree"), scratch(spark, "manifest")
    for name, data in {"a/one.txt": b"one\r\ntwo\n", "b/two.csv": b"x,y\n", "b/three.bin": b"bin\r\n", "cache/left.txt": b"out"}.items():
        write_bytes(spark, f"{root}/{name}", data)
    now = writers.file_digests(readers.read_tree(spark, root, ("cache",)))
    writers.write_hash_manifest(now, path)
    then = readers.read_hash_manifest(spark, path)
    diff = expectations.manifest_diff(then, now, "path", "digest")
    return then.join(diff, "path", "left").select("path", "digest", F.coalesce("status", F.lit("kept")).alias("status"))


# --- flags and small derived tables -------------------------------------------------------------------


@query("SELECT candidate_id FROM cand SEMI JOIN reference_paragraphs USING (doc_id, page)", "cand")
def q_gold_pages(spark, d):
    """Candidates on a page that has reference paragraphs."""
    return candidates(spark, d).join(read(spark, d, "reference_paragraphs").select("doc_id", "page"), ["doc_id", "page"], "left_semi").select("candidate_id")


TRUTH = "CASE WHEN lower(trim(coalesce({c}, ''))) = 'keep' THEN 'positive' WHEN trim(coalesce({c}, '')) = '' THEN 'excluded' ELSE 'negative' END"


@query(f"SELECT candidate_id, {TRUTH.format(c='inclusion_decision_martin')} martin, {TRUTH.format(c='inclusion_decision_dominik')} dominik, coalesce(exclude_untranslated, false) untranslated FROM reviewed_candidates")
def q_truth_map(spark, d):
    """Decisions as three-valued truth (no decision: excluded), flags as booleans."""
    truth = lambda c: scalars.truth_class(F.lower(F.trim(c)), ["keep"], [""])
    raw = read(spark, d, "reviewed_candidates")
    return raw.select("candidate_id", truth("inclusion_decision_martin").alias("martin"), truth("inclusion_decision_dominik").alias("dominik"), scalars.as_bool("exclude_untranslated").alias("untranslated"))


@query(
    """, o AS (SELECT doc_id, page, string_agg(statement_id, ';' ORDER BY statement_id) ids FROM st WHERE provider = 'openai' GROUP BY 1, 2), c AS (SELECT doc_id, page, string_agg(statement_id, ';' ORDER BY statement_id) ids FROM st WHERE provider = 'claude' GROUP BY 1, 2)
    SELECT r.doc_id, r.page::BIGINT page, o.ids IS NOT NULL found_openai, c.ids IS NOT NULL found_claude, o.ids IS NOT NULL OR c.ids IS NOT NULL found_any, concat_ws(';', o.ids, c.ids) ids FROM (SELECT DISTINCT doc_id, page FROM reference_paragraphs) r
    LEFT JOIN o ON o.doc_id = r.doc_id AND o.page = r.page LEFT JOIN c ON c.doc_id = r.doc_id AND c.page = r.page""",
    "st",
)
def q_union_flags(spark, d):
    """Pages of the reference: whether each provider, or any, has a statement there, and the ids of both joined."""
    pages = read(spark, d, "reference_paragraphs").select("doc_id", "page").distinct()
    ids = lambda p: F.sort_array(F.collect_list(F.when(F.col("provider") == p, F.col("statement_id"))))
    got = statements(spark, d).join(pages, ["doc_id", "page"], "left_semi").groupBy("doc_id", "page").agg(*[ids(p).alias(p) for p in PROVIDERS])
    has = {p: F.coalesce(F.size(p) > 0, F.lit(False)) for p in PROVIDERS}
    joined = F.array_join(F.concat(*[F.coalesce(p, F.array().cast("array<string>")) for p in PROVIDERS]), ";")
    return pages.join(got, ["doc_id", "page"], "left").select("doc_id", *big("page"), *[h.alias(f"found_{p}") for p, h in has.items()], (has["openai"] | has["claude"]).alias("found_any"), joined.alias("ids"))


@query("SELECT ref_id, reference_truth = 'positive' AND coalesce(reference_code, '') = '' code_missing, reference_truth <> 'positive' AND coalesce(reference_code, '') <> '' code_unexpected, coalesce(trim(text), '') = '' text_missing FROM reference_paragraphs")
def q_quality_flags(spark, d):
    """What is odd about a reference paragraph: a positive one without a code, another one with one, no text."""
    none = F.coalesce("reference_code", F.lit("")) == ""
    positive = F.col("reference_truth") == "positive"
    return read(spark, d, "reference_paragraphs").select("ref_id", (positive & none).alias("code_missing"), (~positive & ~none).alias("code_unexpected"), (F.coalesce(F.trim("text"), F.lit("")) == "").alias("text_missing"))


SORT = ["variant", "candidate_id", "provider", "code", "odr", "direction", "relation", "strength"]


@query("SELECT variant, candidate_id, provider, code, odr, direction, relation, strength::BIGINT strength, round(mass, 6) mass FROM alloc", "alloc")
def q_allocation_rows(spark, d):
    """The allocation in the order it is exported in, by eight keys."""
    return allocation(spark, d).orderBy(*SORT).select(*SORT[:-1], *big("strength"), *r6("mass"))


@query("SELECT coalesce(p.doc_id, m.doc_id) doc_id, CASE WHEN m.doc_id IS NULL THEN 'left' ELSE 'right' END only_in FROM (SELECT DISTINCT doc_id FROM provider_outputs) p FULL JOIN (SELECT DISTINCT doc_id FROM corpus_manifest) m ON p.doc_id = m.doc_id WHERE p.doc_id IS NULL OR m.doc_id IS NULL")
def q_set_difference(spark, d):
    """Documents with statements but not in the manifest (left), and the other way round."""
    return expectations.set_difference(read(spark, d, "provider_outputs"), read(spark, d, "corpus_manifest"), ["doc_id"])


@query(", n AS (SELECT candidate_id, statement_id, count(*) OVER (PARTITION BY statement_id) n FROM ids) SELECT statement_id, count(DISTINCT candidate_id) candidates FROM n WHERE n > 1 GROUP BY 1 HAVING count(DISTINCT candidate_id) > 1", "ids")
def q_shared_statements(spark, d):
    """Statements that several candidates list: the mapping should be one to one."""
    ids = flatten.candidate_statements(candidates(spark, d), {p: f"{p}_statement_ids" for p in PROVIDERS})
    return ids.groupBy("statement_id").agg(F.count_distinct("candidate_id").alias("candidates")).where("candidates > 1")
