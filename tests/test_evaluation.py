"""Evaluation queries on small tables whose results are known."""

import hashlib
import unicodedata
from datetime import datetime

import numpy as np
import pytest

from attestra import tables as stored
from attestra.operators import textmatch
from attestra.plans import bindings, catalogue, pipelines
from attestra.plans.bindings import matched_paragraphs

QUERIES = catalogue.queries()
STATEMENTS = "record_id long, statement_id string, provider string, unit_id string, doc_id string, page int, quote string, quote_en string, code1 string, odr string, privacy_direction string, privacy_relation string, strength int, source_mode string, received_at timestamp_ntz, qc_status string"
REFERENCE = "ref_id long, gold_id string, paragraph_id string, doc_id string, page int, text string, stratum string, reference_truth string, reference_code string"
DOCUMENTS = "doc_id long, text string, manifest_doc_id string, page int"


@pytest.fixture
def tables(spark, tmp_path):
    """Writes statements (provider, doc, page, quote, quote_en, code, mode), paragraphs (doc, page, text, stratum, truth, code) and documents (doc, page, text)."""

    def write(statements, reference=(), documents=()):
        rows = [(i, f"{p}:{i}", p, "u", d, n, q, e, c, None, None, None, None, m, datetime(2025, 1, 1), "pass" if i % 2 else "fail") for i, (p, d, n, q, e, c, m) in enumerate(statements)]
        refs = [(i, f"{d}-{n}", f"P{i}", d, n, t, s, k, c) for i, (d, n, t, s, k, c) in enumerate(reference)]
        docs = [(i, t, d, n) for i, (d, n, t) in enumerate(documents)]
        for name, data, schema in (("provider_outputs", rows, STATEMENTS), ("reference_paragraphs", refs, REFERENCE), ("documents", docs, DOCUMENTS)):
            spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_fidelity_counts_every_script_and_every_statement(spark, tables):
    sources = {("d", 1): ["Der Schlüs-\nsel bleibt privat.", "Приватність  понад усе"], ("d", 2): ["現金と同じ匿名性", "ﬁnal text"], ("e", 1): ["plain words"]}
    quotes = [
        ("d", 1, "Der Schlüssel bleibt", "text"), ("d", 1, "Приватність понад\nусе", "text"), ("d", 1, "privat. Приватність", "text"), ("d", 2, "同じ匿名性", "render"), ("d", 2, "final text", "text"),
        ("d", 2, "é", "render"), ("e", 1, "plain words", "text"), ("e", 1, None, "text"), ("e", 1, "-", "text_and_render"), ("f", 9, "naïve", "text"), ("f", 9, "naïve", None),
    ]
    where = tables([("openai", d, n, q, q, "A", m) for d, n, q, m in quotes], [("d", 1, t, "probability", "negative", None) for t in sources["d", 1]], [(*k, t) for k in (("d", 2), ("e", 1)) for t in sources[k]])
    span = lambda s: "".join(unicodedata.normalize("NFKC", s).replace("-\n", "").split())
    want = {"supported": 0, "unsupported": 0, "render_review": 0}
    for d, n, q, m in quotes:
        found = q not in (None, "-") and any(span(q) in span(t) for t in sources.get((d, n), []))
        want["supported" if found else "render_review" if m not in (None, "text") else "unsupported"] += 1
    got = QUERIES["q_span_fidelity_all"](spark, where).first().asDict()
    assert {k: got[k] for k in want} == want and sum(want.values()) == len(quotes) and want["supported"] == 5
    assert pipelines.EVALUATION["fidelity"] == "q_span_fidelity_all"


TEXTS = ["Offline payments keep the buyer anonymous towards the bank.", "The central bank audits every intermediary once a year.", "Rural merchants receive a terminal free of charge this spring.", "Nothing on this page is about money at all, says the author."]


def reference(page=1, doc="d"):
    return [(doc, page, TEXTS[0], "probability", "positive", "A.x"), (doc, page, TEXTS[1], "probability", "positive", "B.y"), (doc, page, TEXTS[2], "probability", "negative", None), (doc, page, TEXTS[3], "probability", "excluded", None)]


def test_paragraphs_are_found_by_their_text_not_their_page(spark, tables):
    said = [
        ("openai", "d", 1, TEXTS[0], None, "Z.z", "text"), ("claude", "d", 1, "Offline payments keep the buyer ANONYMOUS towards", None, "A.x", "text"),
        ("claude", "d", 1, "Zahlungen", TEXTS[3], "A.x", "text"), ("openai", "d", 1, "an unrelated statement about something else entirely", None, "B.y", "text"), ("openai", "d", 2, TEXTS[1], None, "B.y", "text"),
    ]
    again = ("d", 1, TEXTS[0], "probability", "positive", "A.x")  # listed twice: both get the answer of the one paragraph
    where = tables(said, [*reference(), again])
    assert {r.ref_id: r.outcome for r in QUERIES["q_matched_outcomes"](spark, where).collect()} == {0: "TP", 1: "FN", 2: "TN", 3: "excluded", 4: "TP"}
    got = {r.who: (r.tp, r.fp, r.fn, r.tn) for r in QUERIES["q_matched_confusion"](spark, where).collect()}
    assert got == {w: (2, 0, 1, 1) for w in ("openai", "claude", "any")}
    hits = {r.ref_id: r.code_hit for r in matched_paragraphs(spark, where).collect()}
    assert hits == {0: True, 1: False, 2: False, 3: False, 4: True}
    assert {"q_confusion_overall", "q_confusion_by_stratum", "q_confusion_page", "q_bootstrap_confusion", "q_positive_coverage"}.isdisjoint(pipelines.EVALUATION.values())


def test_gates_use_the_lower_bound_and_the_matched_workload(spark, tables):
    """27 of 30 positives found (recall 0.90), all misses in one document, so many draws fall far below."""
    texts = [(f"d{i}", t) for i in range(9) for t in TEXTS[:3]]
    refs = [(d, 1, t, "probability", "positive", "A") for d, t in texts] + [("big", 1, t, "probability", "positive", "A") for t in TEXTS[:3]]
    said = [(p, d, 1, t, None, "A", "text") for d, t in texts for p in ("openai", "claude")] + [("openai", "d0", 1, "something the reference does not hold at all", None, "A", "text"), ("claude", "elsewhere", 1, TEXTS[0], None, "A", "text")]
    got = QUERIES["q_matched_gates"](spark, tables(said, refs)).first()
    assert got.recall == 0.9 and got.recall_low < 0.85 and got.e1 == "fail"
    assert got.workload == round(28 / 30, 6) and got.code_recall == 0.9 and (got.e3, got.c1) == ("pass", "pass")
    assert pipelines.EVALUATION["gates"] == "q_matched_gates"


@pytest.fixture
def many(spark, tables):
    """2,000 documents of long names with a positive paragraph each, every second one found, and no broadcast of more than 100 MB; the interval of the recall."""
    names = sorted("".join(hashlib.sha512(b"%d.%d" % (i, j)).hexdigest() for j in range(8)) for i in range(2000))
    where = tables([("openai", d, 1, TEXTS[0], None, "A", "text") for d in names[::2]], [(d, 1, TEXTS[0], "probability", "positive", "A") for d in names])
    picks = lambda draw: (int(hashlib.md5(f"b1|{draw}|{i}".encode()).hexdigest()[:12], 16) % 2000 for i in range(2000))
    recall = np.percentile([sum(i % 2 == 0 for i in picks(draw)) / 2000 for draw in range(2000)], [2.5, 97.5]).round(6).tolist()
    spark.conf.set("spark.sql.maxBroadcastTableSize", "100m")
    yield where, recall
    spark.conf.unset("spark.sql.maxBroadcastTableSize")


def test_bootstrap_of_many_documents_stays_out_of_the_driver(spark, many):
    where, recall = many
    got = QUERIES["q_matched_bootstrap"](spark, where).first()
    assert [got.recall_low, got.recall_high] == recall and (got.precision_low, got.precision_high) == (1.0, 1.0)


def test_gates_of_many_documents_stay_out_of_the_driver(spark, many):
    where, recall = many
    got = QUERIES["q_matched_gates"](spark, where).first()
    assert (got.recall, got.recall_low, got.precision, got.workload, got.e1) == (0.5, recall[0], 1.0, 0.5, "fail")


def test_the_driver_plans_the_matching_of_the_bootstrap_once(spark, tables, monkeypatch):
    plans = []

    def noted(df, label="cut"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored.materialize(df, label)

    for module in (bindings, catalogue, textmatch):
        monkeypatch.setattr(module, "materialize", noted)
    where = tables([("openai", "d1", 1, TEXTS[0], None, "A", "text")], [("d1", 1, TEXTS[0], "probability", "positive", "A")])
    got = QUERIES["q_matched_bootstrap"](spark, where)
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert [p.count("MapInArrow") for p in plans if "MapInArrow" in p] == [2]  # the windows of both sides, in one plan
    assert (got.first().recall_low, got.first().precision_high) == (1.0, 1.0)


def test_draws_are_those_of_the_method(spark, small, monkeypatch):
    asked = {}
    monkeypatch.setattr(catalogue, "_conditions", lambda *a: spark.createDataFrame([("ensemble", "posture", "pages", "e", 1.0, 2.0)], "variant string, measure string, condition string, entity string, x double, y double"))
    monkeypatch.setattr(catalogue, "_entities", lambda *a: spark.createDataFrame([("ensemble", "e", 1.0)], "variant string, entity string, posture double"))
    for name, at in (("exact_inference", 5), ("cluster_bootstrap", 3), ("permutation_test", 4)):
        real = getattr(catalogue.inference, name)
        monkeypatch.setattr(catalogue.inference, name, lambda *a, name=name, at=at, real=real: (asked.__setitem__(name, a[at]), real(*a))[1])
    for q in ("q_exact_inference", "q_cluster_bootstrap", "q_permutation_p"):
        QUERIES[q](spark, small)
    assert asked == {"exact_inference": 10_000, "cluster_bootstrap": 2000, "permutation_test": 10_000}


def test_every_statement_gets_a_quote_status(spark, tables):
    said = [("openai", "d", 1, TEXTS[0], None, "A", "text"), ("openai", "d", 9, TEXTS[0], None, "A", "text"), ("claude", "d", 9, TEXTS[0], None, "A", "render"), ("claude", "d", 9, None, None, "A", None)]
    got = {r.statement_id: r.quote_status for r in QUERIES["q_canonical_quotes"](spark, tables(said, reference())).collect()}
    assert got == {"openai:0": "exact", "openai:1": "unsupported", "claude:2": "render", "claude:3": "unsupported"}


def test_alignment_counts_statements_by_the_truth_they_meet(spark, tables):
    said = [("openai", "d", 1, t, None, "A", "text") for t in [*TEXTS, "a statement no paragraph holds in any form"]] + [("claude", "d", 1, TEXTS[0], None, "A", "text"), ("claude", "off", 1, TEXTS[0], None, "A", "text")]
    got = {r.who: tuple(r)[1:] for r in QUERIES["q_alignment"](spark, tables(said, reference())).collect()}
    assert got == {"openai": (2, 1, 1, 1, 0.5), "claude": (1, 0, 0, 0, 1.0), "any": (3, 1, 1, 1, 0.6)}
    assert pipelines.EVALUATION["alignment"] == "q_alignment"


def test_screening_of_pages(spark, tables):
    near = "Offline payments keep the buyer anonymous towards every shop and bank."
    said = [
        ("openai", "d", 1, TEXTS[0], None, "A", "text"), ("claude", "d", 1, near, None, "A", "text"), ("openai", "d", 1, "zz", TEXTS[1][:40], "A", "text"),
        ("claude", "d", 1, "completely unrelated words without any shared run", None, "A", "text"), ("openai", "off", 1, TEXTS[0], None, "A", "text"),
    ]
    where = tables(said, [*reference(), ("d", 1, TEXTS[0], "stress_long", "negative", None)])
    pairs = {(r.statement_id, r.par): (r.method, r.field) for r in QUERIES["q_statement_paragraph"](spark, where).collect()}
    assert pairs == {("openai:0", 0): ("raw_equal", "quote"), ("claude:1", 0): ("fuzzy_character", "quote"), ("openai:2", 1): ("raw_contains", "quote_en")}
    assert {(r.par, r.n, r.best_score, r.best_statement) for r in QUERIES["q_paragraph_best"](spark, where).collect()} == {(0, 2, 1.0, "openai:0"), (1, 1, 1.0, "openai:2"), (2, 0, 0.0, None), (3, 0, 0.0, None)}
    assert {(r.statement_id, r.par) for r in QUERIES["q_greedy_paragraph"](spark, where).collect()} == set(pairs)
    got = {r.candidates: r.asDict() for r in QUERIES["q_candidate_summary"](spark, where).collect()}
    assert got["all"] == {"candidates": "all", "on_pages": 4, "assigned": 3, "unassigned": 1, "assigned_positive": 3, "assigned_negative": 0, "assigned_excluded": 0, "whole_paragraph_equal": 1, "span_containment_matches": 2, "fuzzy_matches": 1}
    assert (got["kept"]["on_pages"], got["kept"]["assigned"]) == (2, 1)  # those with an odd number passed
    rows = {r.stratum: (r.tp, r.fp, r.fn, r.tn) for r in QUERIES["q_screen_confusion"](spark, where).collect()}
    assert rows == {"probability": (2, 0, 0, 1), None: (2, 0, 0, 1)}


def test_composites_stay_out_of_the_grid_and_the_correction_has_one_family(spark, small):
    rows = QUERIES["q_exact_inference"](spark, small).collect()
    assert {(r.variant, r.measure, r.condition) for r in rows if r.p_holm is not None} <= {("ensemble", m, c) for m in catalogue.MEASURES for c in catalogue.CONDITIONS}
    assert {(r.measure, r.condition) for r in rows} == {(m, c) for m in catalogue.MEASURES for c in catalogue.CONDITIONS} | {("relation", "vocabulary")}
    assert catalogue._conditions(spark, small).where("entity = 'XE'").count() == 0
