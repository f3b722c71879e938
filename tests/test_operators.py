"""Operators against brute force, published figures and their edge cases."""

import hashlib
import itertools
import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.functions import scalars
from attestra.operators import allocate, assign, evaluate, expectations, flatten, inference, reliability, score, survey, textmatch
from attestra.tables import materialize


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_flatten_numbers_statements_and_skips_empty_units(spark):
    st = {"block_id": "b", "quote": "q", "quote_en": None, "code1": "A.b", "odr": "decision", "privacy_direction": None, "privacy_relation": None, "strength": 2, "source_mode": "text"}
    docs = [("r1", [{"unit_id": "u1", "status": "ok", "statements": [st, st]}, {"unit_id": "u2", "status": "ok", "statements": []}]), ("r2", None)]
    out = flatten.flatten(spark.createDataFrame(docs, flatten.RESPONSE_SCHEMA), "x").orderBy("ordinal").collect()
    assert [r.statement_id for r in out] == ["x:u1:S001", "x:u1:S002"] and out[0].quote_en is None


def test_split_ids_drops_blanks(spark):
    rows = spark.createDataFrame([("a; b;;",), (None,), ("",)], "v string").select(scalars.split_ids("v").alias("x")).collect()
    assert [r.x for r in rows] == [["a", "b"], [], []]


def test_paginate_loses_nothing(spark):
    texts = [(1, "abc def " * 30), (2, ""), (3, None), (4, "x" * 55)]
    fits = flatten.paginate(spark.createDataFrame([(1, "hello world"), (2, "x" * 20), (3, "ab cd " * 4), (4, " ")], "id int, t string"), "id", "t", 20).groupBy("id").agg(F.collect_list("piece").alias("p"))
    assert {r.id: sorted(r.p) for r in fits.collect()} == {1: ["hello world"], 2: ["x" * 20], 3: sorted(["ab cd ab cd ab cd ab", " cd "]), 4: [" "]}
    out = flatten.paginate(spark.createDataFrame(texts, "id int, t string"), "id", "t", 20).orderBy("id", "ordinal").collect()
    for i, t in texts:
        pieces = [r.piece for r in out if r.id == i]
        assert "".join(pieces) == (t or "") and all(len(p) <= 20 for p in pieces)


def test_canonical_quotes(spark):
    src = "one  two\nthree two two"
    rows = [("one  two", src, False), ("one two", src, False), ("two", src, False), ("t w o", "two two", False), ("zzz", src, True), ("zzz", src, False), (None, src, False), ("a", None, False)]
    out = flatten.canonical_quotes(spark.createDataFrame(rows, "q string, s string, r boolean"), "q", "s", "r").collect()
    assert [r.quote_status for r in out] == ["exact", "restored", "exact", "ambiguous", "render", "unsupported", "unsupported", "unsupported"]
    assert out[1].quote_span == "one  two"


def test_retry_merge_keeps_main_unless_retry_succeeded(spark):
    main = spark.createDataFrame([("u1", 1), ("u2", 2), (None, 9)], "unit_id string, v int")
    retry = spark.createDataFrame([("u1", 10), ("u3", 30), ("u2", -1)], "unit_id string, v int")
    out = {(r.unit_id, r.v, r.replaced) for r in flatten.retry_merge(main, retry, "unit_id", F.col("v") > 0).collect()}
    assert out == {("u1", 10, True), ("u2", 2, False), (None, 9, False)}


EVIDENCE = "candidate_id string, provider string, code string, odr string, privacy_direction string, privacy_relation string, strength int, quote string, quote_en string, statement_id string, extra string"


def test_allocation_splits_mass(spark):
    rows = [
        ("c1", "a", "P.x", "decision", None, "", 0, "long text", None, "s1", "z"), ("c1", "a", "P.x", "decision", "neutral", "not_applicable", 1, "text", None, "s2", "z"),
        ("c1", "a", "P.y", "proposal", "increases", "from_state", 9, "t", "", "s3", "z"), ("c1", "b", "P.x", None, None, None, None, None, None, "s4", "z"),
        (None, "a", "P.x", None, None, None, None, None, None, "s5", "z"), ("c2", "b", "Q", None, None, None, None, None, None, "s6", "z"),
    ]
    cells = allocate.contributions(spark.createDataFrame(rows, EVIDENCE))
    got = {(r.candidate_id, r.provider, r.code): (r.part, r.strength, r.statement_id) for r in cells.collect()}
    assert got[("c1", "a", "P.x")] == (0.5, 1, "s1") and got[("c1", "a", "P.y")][:2] == (0.5, 3) and got[("c1", "b", "P.x")][0] == 1.0 and len(got) == 4
    fanned = allocate.variants(cells, ("a", "b"))
    assert allocate.mass_check(fanned).count() == 0
    assert {r.variant for r in fanned.where("candidate_id = 'c2'").collect()} == {"ensemble", "b"}
    empty = allocate.contributions(spark.createDataFrame([], EVIDENCE))
    assert allocate.variants(empty, ("a", "b")).count() == 0


def test_calibration_and_thresholds(spark):
    df = spark.createDataFrame([(float(i), 1.0) for i in range(101)], "v double, c double")
    t = one(score.thresholds(df, ["v", "c"]))
    assert (t.v_lo, t.v_mid, t.v_hi) == (5.0, 50.0, 95.0) and t.c_lo < t.c_mid < t.c_hi
    lit = F.lit
    vals = spark.createDataFrame([(5.0,), (50.0,), (95.0,), (1000.0,), (-1000.0,)], "v double").select(scalars.calibrate(F.col("v"), lit(5.0), lit(50.0), lit(95.0)).alias("x"))
    assert [round(r.x, 6) for r in vals.collect()] == [0.05, 0.5, 0.95, 0.95, 0.05]


def test_dominant_first_wins_ties(spark):
    df = spark.createDataFrame([(0.5, 0.5, 0.1), (0.1, 0.2, 0.9)], "score_a double, score_b double, score_c double")
    out = score.dominant(df, ["a", "b", "c"]).collect()
    assert [(r.dominant, r.narrow) for r in out] == [("a", True), ("c", False)] and out[1].second_score == 0.2


def test_confusion_undefined_rates(spark):
    df = spark.createDataFrame([("negative", False), ("excluded", True), (None, True)], "truth string, p boolean")
    r = one(evaluate.confusion(df, "p"))
    assert (r.tp, r.fp, r.fn, r.tn) == (0, 0, 0, 1) and r.precision is None and r.recall is None and r.f1 == 0.0


def test_published_confusion_rates(spark):
    r = one(evaluate.with_rates(spark.createDataFrame([(49, 1, 15, 185)], "tp long, fp long, fn long, tn long")))
    assert r.precision == 0.98 and r.recall == 0.765625


def test_per_class(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", None), (None, "d")], "t string, p string")
    got = {r.label: (r.support, r.predicted, r.tp, r.precision, r.recall) for r in evaluate.per_class(df, "t", "p").collect()}
    assert got == {"a": (2, 1, 1, 1.0, 0.5), "b": (1, 2, 1, 0.5, 1.0), "c": (1, 0, 0, 0.0, 0.0), "d": (0, 1, 0, 0.0, 0.0)}
    assert one(evaluate.macro(evaluate.per_class(df, "t", "p"))).degenerate == 2


def test_gates_fail_on_undefined(spark):
    cols = "recall double, recall_low double, stress_recall double, stress_positives long, precision double, workload double, code_recall double, coded long"
    good, none = (0.95, 0.9, 0.9, 20, 0.9, 1.5, 0.9, 20), (None,) * 8
    out = evaluate.gates(spark.createDataFrame([good, none], cols)).collect()
    assert [(r.e1, r.e2, r.e3, r.c1) for r in out] == [("pass",) * 4, ("fail",) * 4]


def test_published_reliability(spark):
    """Figures follow from 364 pairs: 214 both keep, 14 both exclude, keeps 288 and 276."""
    pairs = [("keep", "keep")] * 214 + [("exclude", "exclude")] * 14 + [("keep", "exclude")] * 74 + [("exclude", "keep")] * 62
    r = one(reliability.two_raters(spark.createDataFrame(pairs, "l string, r string"), "l", "r"))
    assert r.n == 364 and r.agree == 228 and abs(r.alpha + 0.06893271060370165) < 1e-12 and abs(r.ac1 - 0.4260272701975698) < 1e-12


def test_reliability_edges(spark):
    same = one(reliability.two_raters(spark.createDataFrame([("a", "a"), ("a", "a"), (None, "a"), ("", "a")], "l string, r string"), "l", "r"))
    assert (same.n, same.missing, same.agreement, same.alpha) == (2, 2, 1.0, None)
    none = one(reliability.two_raters(spark.createDataFrame([], "l string, r string"), "l", "r"))
    assert none.n == 0 and none.agreement is None and none.alpha is None


def test_published_wilson(spark):
    low, high = scalars.wilson(F.lit(1), F.lit(31))
    r = one(spark.range(1).select(low.alias("l"), high.alias("h")))
    assert abs(r.l - 0.005717221525416816) < 1e-12 and abs(r.h - 0.16194105164724906) < 1e-12
    low, high = scalars.wilson(F.lit(0), F.lit(0))
    assert one(spark.range(1).select(low.alias("l"))).l is None


def test_stratified_single_row_stratum(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("b", 1.0), ("z", 1.0), (None, 1.0)], "s string, v double")
    design = spark.createDataFrame([("a", 10), ("b", 30), ("empty", 60)], "stratum string, population long")
    r = one(survey.stratified(rows, "v", "s", design))
    assert abs(r.estimate - (0.1 * 0.5 + 0.3)) < 1e-12
    assert abs(r.standard_error**2 - (0.01 * 0.8 * 0.5 / 2 + 0.09 * (1 - 1 / 30) * 0.25)) < 1e-12


def test_sample_size():
    n, achieved = survey.sample_size(6949, z=1.96)
    assert n == 365 and abs(achieved - 0.0499338) < 1e-6
    assert survey.sample_size(0) == (0, 0.0)


def test_hash_sample_is_the_smallest_digests(spark):
    import hashlib

    rows = spark.createDataFrame([(str(i), "a" if i % 3 else None) for i in range(200)], "id string, s string")
    got = survey.hash_sample(rows, "id", ["s"], 0.1, "x").collect()
    for s in ("a", None):
        ids = [str(i) for i in range(200) if ("a" if i % 3 else None) == s]
        n = -(-len(ids) // 10)
        want = sorted(ids, key=lambda i: hashlib.sha256(f"x|{i}".encode()).hexdigest())[:n]
        assert sorted(r.id for r in got if r.s == s) == sorted(want)
    assert all(abs(r.inclusion_probability * r.weight - 1) < 1e-12 for r in got)


def test_correlation_of_constants_is_null(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, None)], "x double, y double")
    assert one(df.agg(inference.correlation("x", "y").alias("r"))).r is None
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.5)], "x double, y double")
    assert one(df.agg(inference.correlation("x", "y").alias("r"))).r > 0.99


def test_holm_by_hand(spark):
    tests = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03), ("f", "d", None), ("g", "a", 0.5)], "fam string, t string, p double")
    got = {(r.fam, r.t): r.p_holm for r in inference.holm(tests, ["fam"], "p", ["t"]).collect()}
    assert got[("f", "a")] == pytest.approx(0.03) and got[("f", "c")] == pytest.approx(0.06) and got[("f", "b")] == pytest.approx(0.06) and got[("f", "d")] is None and got[("g", "a")] == 0.5


def test_bootstrap_interval_holds_the_point(spark):
    rows = spark.createDataFrame([(f"d{i}", 8 + i % 3, 1, 2) for i in range(20)], "doc string, tp long, fp long, fn long")
    r = one(inference.bootstrap_confusion(rows, "doc", 300, "s"))
    assert r.precision_low <= 180 / 200 <= r.precision_high and r.recall_low < r.recall_high
    again = one(inference.bootstrap_confusion(rows.repartition(3), "doc", 300, "s"))
    assert r == again


def drawn(names, draws):
    """Names that every draw of seed s takes, in plain Python."""
    return {d: [names[int(hashlib.md5(f"s|{d}|{i}".encode()).hexdigest()[:12], 16) % len(names)] for i in range(len(names))] for d in range(draws)}


def test_bootstrap_never_broadcasts_its_picks(spark):
    """300,000 picks stay where they are made, also if Spark takes them for less than the clusters."""
    data = {hashlib.sha512(b"%d" % i).hexdigest(): (i % 7, i * i % 11) for i in range(1500)}
    rows = spark.createDataFrame([(k, *v) for k, v in data.items()], "doc string, tp long, fp long")
    want = {d: tuple(sum(data[n][c] for n in names) for c in (0, 1)) for d, names in drawn(sorted(data), 200).items()}
    spark.conf.set("spark.sql.maxBroadcastTableSize", "2m")
    try:
        for totals in (materialize(rows), rows):  # small enough to be broadcast, and of unknown size
            assert {r.draw: (r.tp, r.fp) for r in inference.resample(totals, "doc", ["tp", "fp"], 200, "s").collect()} == want
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert inference.resample(rows.limit(0), "doc", ["tp"], 20, "s").count() == inference.resample(rows, "doc", ["tp"], 0, "s").count() == 0


def test_bootstrap_numbers_a_null_cluster_last(spark):
    data = {"a": 1, "b": 10, None: 100}
    rows = spark.createDataFrame(list(data.items()), "doc string, tp long")
    assert {r.draw: r.tp for r in inference.resample(rows, "doc", ["tp"], 30, "s").collect()} == {d: sum(data[n] for n in names) for d, names in drawn(["a", "b", None], 30).items()}


def test_poisson_bootstrap_agrees_with_the_multinomial(spark):
    rows = spark.createDataFrame([(f"d{i}", 8 + i % 3, i % 2, 2) for i in range(300)], "doc string, tp long, fp long, fn long")
    a, b = one(inference.bootstrap_confusion(rows, "doc", 400, "s")), one(inference.bootstrap_confusion(rows, "doc", 400, "s", poisson=True))
    assert abs(a.precision_low - b.precision_low) < 0.01 and abs(a.recall_high - b.recall_high) < 0.01
    assert {r.draw: r.tp for r in inference.resample_poisson(rows, "doc", ["tp"], 20, "s").collect()} == {r.draw: r.tp for r in inference.resample_poisson(rows.repartition(5), "doc", ["tp"], 20, "s").collect()}
    assert inference.resample_poisson(rows.limit(0), "doc", ["tp"], 20, "s").count() == 0


def test_cluster_bootstrap(spark):
    rows = spark.createDataFrame([(f"d{i % 5}", float(i)) for i in range(25)], "c string, v double")
    r = one(inference.cluster_bootstrap(rows, "c", lambda pdf: pdf.v.mean(), 60, 7))
    assert r.value_low <= 12 <= r.value_high
    assert one(inference.cluster_bootstrap(rows.limit(0), "c", lambda pdf: pdf.v.mean(), 10, 7)).value_low is None


def test_exact_inference_and_permutation(spark):
    rows = spark.createDataFrame([("t", f"k{i}", float(i), float(i * i)) for i in range(12)], "t string, k string, x double, y double")
    e = one(inference.exact_inference(rows, ["t"], "x", "y", "t", 200))
    p = one(inference.permutation_test(rows, "k", "x", "y", 200, "s"))
    assert e.n == p.n == 12 and abs(e.r - p.r) < 1e-9 and e.low <= e.r <= e.high and e.p < 0.02 and p.p < 0.02
    flat = rows.withColumn("y", F.lit(1.0))
    assert one(inference.exact_inference(flat, ["t"], "x", "y", "t", 20)).p is None


def brute(edges, lefts):
    best = (0, 0.0)
    by = {}
    for l, r, s in edges:
        by.setdefault(l, []).append((r, s))
    for choice in itertools.product(*[[None, *by.get(l, [])] for l in lefts]):
        picked = [c for c in choice if c]
        if len({r for r, _ in picked}) == len(picked):
            best = max(best, (len(picked), round(sum(s for _, s in picked), 6)))
    return best


@pytest.mark.parametrize("seed", range(30))
def test_one_to_one_is_optimal(seed):
    rng = random.Random(seed)
    edges = [(f"l{a}", f"r{b}", rng.choice([0.8, 0.85, 0.9, 1.0])) for a in range(5) for b in range(5) if rng.random() < 0.45]
    got = assign.one_to_one(edges)
    assert (len(got), round(sum(s for *_, s in got), 6)) == brute(edges, [f"l{a}" for a in range(5)])
    shuffled = edges[:]
    rng.shuffle(shuffled)
    assert assign.one_to_one(shuffled) == got


def test_one_to_one_properties():
    assert assign.one_to_one([]) == []
    assert len(assign.one_to_one([("a", 1, 0.9), ("a", 2, 1.0), ("b", 1, 1.0)])) == 2  # augmenting path
    assert len(assign.one_to_one([("a", 1, 1.0), ("a", 2, 0.8), ("b", 1, 0.8)])) == 2  # size before score
    assert assign.one_to_one([("a", 1, 0.8), ("a", 1, 0.9)]) == [("a", 1, 0.9)]  # parallel edges
    rng = random.Random(1)
    big = [(i, j, round(0.8 + rng.random() / 5, 3)) for i in range(40) for j in range(40) if rng.random() < 0.3]
    assert len(assign.one_to_one(big)) == 40
    many = assign.one_to_one([(i, j, 1.0) for i in range(23) for j in range(141)])
    assert len(many) == 23


def difflib_score(q, p):
    """The plain search: longest common block of tokens or characters, over the shorter side."""
    best, method = 0.0, "none"
    for name, a, b, short_run, run, least in (("fuzzy_token", q.split(), p.split(), 4, 6, 4), ("fuzzy_character", q.replace(" ", ""), p.replace(" ", ""), 20, 20, 20)):
        short = min(len(a), len(b))
        if short >= least:
            size = SequenceMatcher(None, a, b, autojunk=False).find_longest_match().size
            if size >= (short_run if short <= 6 else run) and size / short > best:
                best, method = size / short, name
    return best, method


@pytest.mark.parametrize("seed", range(10))
def test_longest_runs_equal_difflib(seed):
    rng = random.Random(seed)
    pairs = [(rng.choices(range(4), k=rng.randint(0, 40)), rng.choices(range(4), k=rng.choice([0, 3, 17, 200]))) for _ in range(60)]
    want = [SequenceMatcher(None, a, b, autojunk=False).find_longest_match().size for a, b in pairs]
    arrays = [(np.array(a, np.int64), np.array(b, np.int64)) for a, b in pairs]
    assert textmatch.longest_runs(arrays).tolist() == want
    assert [textmatch._run_by_windows(a, b) for a, b in arrays] == want
    kept, textmatch.CELLS = textmatch.CELLS, 50
    try:
        assert textmatch.longest_runs(arrays).tolist() == want
    finally:
        textmatch.CELLS = kept


@pytest.mark.parametrize("seed", range(10))
def test_fuzzy_scores_equal_difflib(seed):
    rng = random.Random(seed)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    qs, ps = [], []
    for _ in range(40):
        q = rng.choices(words, k=rng.randint(1, 14))
        p = q[:]
        p[rng.randrange(len(p))] = rng.choice(words)
        qs.append(" ".join(q))
        ps.append((" " if rng.random() < 0.7 else "").join(p + rng.choices(words, k=rng.randint(0, 5))))
    score, method = textmatch.fuzzy_scores(qs + [None], ps + ["x"])
    assert [(round(s, 9), m) for s, m in zip(score, method)] == [(round(s, 9), m) for s, m in map(difflib_score, qs, ps)] + [(0.0, "none")]


def test_containment_equals_brute_force(spark):
    rng = random.Random(4)
    make = lambda: "".join(rng.choices("ab ", k=rng.choice([0, 1, 2, 5, 11, 12, 13, 40])))
    rows = sorted({(f"d{rng.randint(0, 2)}", make()) for _ in range(150)})
    df = spark.createDataFrame([(d, i, v) for i, (d, v) in enumerate(rows)], "doc string, h long, v string")
    got = {(r.l, r.r) for r in textmatch.contained(df, df, ["doc"], "h", "v").collect()}
    assert got == {(i, j) for i, (d, a) in enumerate(rows) for j, (e, b) in enumerate(rows) if d == e and a and a in b}


def test_single_edges_are_matched_without_python(spark):
    rng = random.Random(3)
    edges = [(f"d{rng.randint(0, 3)}", f"l{rng.randint(0, 9)}", f"r{rng.randint(0, 9)}", rng.choice([0.8, 0.9, 1.0]), "m", "clash") for _ in range(60)]
    df = spark.createDataFrame(edges, "doc string, l string, r string, score double, method string, n string")
    got = {}
    for r in assign.assign(df, ["doc"]).collect():
        got.setdefault(r.doc, []).append((r.l, r.r, r.score))
    for d in {e[0] for e in edges}:
        want = assign.one_to_one([e[1:4] for e in edges if e[0] == d])
        assert len(got[d]) == len(want) and sum(x[2] for x in got[d]) == pytest.approx(sum(x[2] for x in want))
        assert len({x[0] for x in got[d]}) == len({x[1] for x in got[d]}) == len(got[d])
    assert assign.assign(df.limit(0), ["doc"]).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_pruned_fuzzy_equals_the_full_search(seed):
    rng = random.Random(seed)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    q = " ".join(rng.choices(words, k=rng.randint(1, 14)))
    p = q
    if rng.random() < 0.8:
        cut = p.split()
        cut[rng.randrange(len(cut))] = rng.choice(words)
        p = " ".join(cut + rng.choices(words, k=rng.randint(0, 5)))
    full, pruned = textmatch.fuzzy(q, p), textmatch.fuzzy(q, p, 0.8)
    assert pruned == full if full[0] >= 0.8 else pruned[0] < 0.8


def test_seeded_candidates_lose_no_pair(spark):
    rng = random.Random(11)
    words = "the central bank limits offline payment mode for merchants in three regions after a public review of fees and rules".split()
    make = lambda: " ".join(rng.choices(words, k=rng.randint(1, 18)))
    left = [make() for _ in range(60)] + ["a", "—", "", "bank", "x" * 50]
    right = []
    for t in left:
        cut = t.split()
        if cut and rng.random() < 0.7:
            cut[rng.randrange(len(cut))] = rng.choice(words)
        if rng.random() < 0.3:
            cut = rng.choices(words, k=rng.randint(1, 30)) + cut
        right.append((" " if rng.random() < 0.8 else "").join(cut))
    cols = "doc string, page int, id string, v string"
    a = spark.createDataFrame([("d", 1 if i % 5 else None, f"a{i}", t) for i, t in enumerate(left)], cols)
    b = spark.createDataFrame([("d", 1 if i % 5 else 2, f"b{i}", t) for i, t in enumerate(right)], cols)
    for threshold in (0.8, 0.5):
        got = {(r.l, r.r): round(r.score, 9) for r in textmatch.edges(a, b, ["doc", "page"], "id", "id", ["v"], ["v"], threshold).collect()}
        every = a.select("doc", "page", "id", "v").join(b.select("doc", "page", F.col("id").alias("rid"), F.col("v").alias("w")), ["doc", "page"])
        want = {(r.id, r.rid): round(r.score, 9) for r in textmatch.score_pairs(every, "v", "w").where(F.col("score") >= threshold).collect()}
        assert got == want and want


def test_winnowing_guarantee():
    rng = np.random.default_rng(5)
    for _ in range(200):
        k = int(rng.integers(2, 9))
        shared = rng.integers(0, 4, 2 * k - 1)
        a, b = (np.concatenate([rng.integers(0, 4, rng.integers(0, 20)), shared, rng.integers(0, 4, rng.integers(0, 20))]) for _ in range(2))
        assert set(textmatch.winnowed(a, k).tolist()) & set(textmatch.winnowed(b, k).tolist())


def test_score_ladder(spark):
    long_ = "the central bank limits the offline payment mode for merchants"
    rows = [
        (long_, long_, "raw_equal"), ("central bank", long_, "raw_contains"), (long_.upper() + "!", long_, "normalized_equal"), ("Central-Bank limits the", long_, "normalized_contains"),
        (long_ + " today", "Offline payment, mode for MERCHANTS", "normalized_container"), ("short", "other", "none"), (None, long_, "none"), ("  ", long_, "none"),
        ("extraordinarily the central bank limits the offline payment", long_, "fuzzy_token"), ("thecentralbanklimitsthe offlinepayment", long_, "fuzzy_character"),
    ]
    out = textmatch.score_pairs(spark.createDataFrame([(a, b) for a, b, _ in rows], "q string, p string"), "q", "p").collect()
    assert [r.method for r in out] == [m for *_, m in rows]
    word = spark.createDataFrame([("d", "a", None), ("d", "b", "None")], "doc string, id string, v string")
    met = {(r.l, r.r) for r in textmatch.edges(word, word, ["doc"], "id", "id", ["v"], ["v"], 0.8, null_as_literal=True).collect()}
    assert met == {("a", "a"), ("a", "b"), ("b", "a"), ("b", "b")}
    literal = textmatch.score_pairs(spark.createDataFrame([(None, None)], "q string, p string"), "q", "p", null_as_literal=True)
    assert one(literal).method == "raw_equal"


def test_edges_greedy_and_assignment(spark):
    cols = "doc string, page int, id string, quote string, quote_en string"
    a = spark.createDataFrame([("d", 1, "a1", "the quick brown fox jumps", None), ("d", 1, "a2", "the quick brown fox jumps", None), ("d", 2, "a3", "nothing to see here at all", None)], cols)
    b = spark.createDataFrame([("d", 1, "b1", "the quick brown fox jumps", None), ("d", 1, "b2", "he said: the quick brown fox jumps", None), ("d", 3, "b3", None, None)], cols)
    e = textmatch.edges(a, b, ["doc", "page"], "id", "id", ["quote", "quote_en"], ["quote", "quote_en"], 0.8)
    assert {(r.l, r.r) for r in e.collect()} == {("a1", "b1"), ("a1", "b2"), ("a2", "b1"), ("a2", "b2")}
    assert {(r.l, r.r) for r in textmatch.greedy(e).collect()} == {("a1", "b1"), ("a2", "b1")}
    m = assign.assign(e, ["doc", "page"])
    assert m.count() == 2
    rec = {r.l: r.assignment_status for r in assign.records(a, "id", m, e, ["doc"]).collect()}
    assert rec == {"a1": "assigned", "a2": "assigned", "a3": "unassigned"}


def test_english_labels(spark):
    labels = ["en", " EN ", "eng", "en-GB", "English", "en_us", "german", "english/german", "", None, "xen"]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in labels], "v string").select(scalars.names_english("v")).collect()] == [True] * 6 + [False] * 5


def test_two_raters_by_group(spark):
    rows = [("m", "a", "a", 1.0), ("m", "a", "b", 1.0), ("n", "x", "x", 2.0), ("n", "y", "y", 1.0), ("n", None, "y", 1.0), ("o", None, None, 1.0)]
    df = spark.createDataFrame(rows, "g string, l string, r string, w double")
    got = {r.g: r for r in reliability.two_raters(df, "l", "r", "w", by=["g"]).collect()}
    for g in ("m", "n", "o"):
        alone = one(reliability.two_raters(df.where(F.col("g") == g), "l", "r", "w"))
        assert tuple(got[g])[1:] == tuple(alone)


def test_generic_bootstrap_checks_its_size(spark, monkeypatch):
    monkeypatch.setattr(inference, "MAX_LOCAL", 5)
    with pytest.raises(ValueError):
        inference.cluster_bootstrap(spark.range(9).selectExpr("id c", "1.0 v"), "c", lambda pdf: pdf.v.mean(), 5, 1)


def test_normalizers(spark):
    rows = spark.createDataFrame([("Straße  Ｆｕｌｌ—x_1",), (None,), ("",), ("A-b\nC",)], "v string")
    assert [r.x for r in rows.select(scalars.normalize_text("v").alias("x")).collect()] == ["strasse full x_1", None, "", "a b c"]
    spans = spark.createDataFrame([("off-\nline­é x",), ("off-\nline y",), (None,)], "v string").select(scalars.normalize_span("v").alias("x"))
    assert [r.x for r in spans.collect()] == ["offlineéx", "offliney", None]


def test_expectations(spark):
    t = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "k int, v string")
    assert [(r.k, r.n) for r in expectations.duplicates(t, ["k"]).collect()] == [(1, 2)]
    assert {(r.rule, r.n) for r in expectations.violations(t, {"v given": F.col("v").isNotNull(), "k": F.col("k") > 0}).collect()} == {("v given", 1), ("k", 0)}
    d = expectations.set_difference(t, spark.createDataFrame([(2,), (3,)], "k int"), ["k"])
    assert {(r.k, r.only_in) for r in d.collect()} == {(1, "left"), (3, "right")}
    m = expectations.manifest_diff(spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "p string, h string"), spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "p string, h string"), "p", "h")
    assert {(r.path, r.status) for r in m.collect()} == {("b", "changed"), ("c", "removed"), ("d", "added")}


def test_lexicon_counts_patterns_not_matches(spark):
    rows = spark.createDataFrame([("Privacy privacy ANONYM",), (None,)], "t string")
    assert [r.n for r in rows.select(scalars.keyword_hits("t", ["privacy", "anonym", "privac"]).alias("n")).collect()] == [3, 0]
