"""Consensus, survivors, quotas, mixes and the prefix selection under them."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.llm import consensus, mixing, prefix, quota, survivor

# --- consensus ---

CODES = ["A.x", "A.y", "A.z", "B.x", "B.y", "C"]


def reviews(seed=1, items=400):
    rng = random.Random(seed)
    truth, rows = {}, []
    for i in range(items):
        t = "" if rng.random() < 0.4 else rng.choice(CODES)
        truth[f"i{i}"] = t
        guess = lambda: rng.choice(["", *CODES])
        kin = lambda c: rng.choice([x for x in CODES if x[0] == c[0] and x != c] or [c])
        says = {
            "good1": t if rng.random() < 0.9 else guess(), "good2": t if rng.random() < 0.85 else guess(), "good3": (kin(t) if t and rng.random() < 0.2 else t),
            "always_no": "", "always_yes": t if t and rng.random() < 0.3 else rng.choice(CODES), "liar": rng.choice(CODES) if t == "" else "", "coin": guess(),
        }
        rows += [(f"i{i}", who, label) for who, label in says.items() if rng.random() < 0.85]
    return truth, rows


def test_consensus_beats_the_majority(spark):
    truth, rows = reviews()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "item string, annotator string, label string, who string")
    model = consensus.Consensus(df)
    got = {r.item: (r.label if r.keep else "") for r in model.result().collect()}
    right = np.mean([got[i] == t for i, t in truth.items() if i in got])
    votes = {}
    for i, _, label in rows:
        votes.setdefault(i, []).append(label)
    majority = np.mean([max(sorted(set(votes[i])), key=votes[i].count) == t for i, t in truth.items() if i in votes])
    assert right > 0.9 and right > majority + 0.05
    rel = {r.annotator: r for r in model.reliability().collect()}
    assert rel["good1"].p_label_right > 0.7 > rel["coin"].p_label_right and rel["liar"].p_null_right < 0.3 and rel["always_no"].p_keep_right < 0.2 and rel["always_yes"].p_null_right < 0.2


def test_consensus_edges(spark):
    schema = "item string, annotator string, label string"
    empty = consensus.Consensus(spark.createDataFrame([], schema))
    assert empty.result().count() == 0 and empty.reliability().count() == 0
    rows = [("i", "a", "X"), ("i", "a", "X"), ("i", "b", None), (None, "a", "X"), ("j", None, "X"), ("k", "a", ""), ("k", "b", "")]
    out = {r.item: r for r in consensus.Consensus(spark.createDataFrame(rows, schema)).result().collect()}
    assert set(out) == {"i", "k"} and out["i"].label == "X" and not out["k"].keep and out["k"].label is None
    assert all(0 <= r.p_keep <= 1 for r in out.values())


def test_item_with_very_many_labels(spark):
    rows = [("hot", f"a{i}", "A.x" if i % 3 else "B.x") for i in range(300)] + [(f"i{k}", f"a{i}", "A.y") for k in range(5) for i in range(3)]
    out = {r.item: r.label for r in consensus.Consensus(spark.createDataFrame(rows, "item string, annotator string, label string")).result().collect()}
    assert out["hot"] == "A.x" and len(out) == 6


def test_keep_vote_without_a_code_counts_for_the_decision(spark):
    schema = "item string, annotator string, label string"
    rows = [(f"i{k}", who, "A.x" if k % 2 else "") for k in range(40) for who in ("a", "b", "c")]
    votes = [("n", "a", consensus.SOME_CLASS), ("n", "b", consensus.SOME_CLASS), ("n", "c", ""), ("m", "a", consensus.SOME_CLASS), ("m", "b", "A.x"), ("m", "c", "")]
    model = consensus.Consensus(spark.createDataFrame(rows + votes, schema))
    out = {r.item: r for r in model.result().collect()}
    assert out["n"].keep and out["n"].label is None and out["m"].keep and out["m"].label == "A.x" and len(out) == 42
    assert all(b >= a - 1e-9 * abs(a) for a, b in zip(model.objective, model.objective[1:]))


def test_equal_codes_of_wrong_keeps_do_not_decide(spark):
    """Reviewers who wrongly keep an item code it by its content, so their codes agree."""
    rng = random.Random(12)
    worth = {"a": (0.95, 0.9), "b": (0.9, 0.85), "c": (0.85, 0.8), "flips": (0.1, 0.4), "always": (None, 0.6), "never": (None, 0.6)}
    truth, rows = {}, []
    for i in range(500):
        keep, code = rng.random() < 0.6, rng.choice(CODES)
        truth[f"i{i}"] = (keep, code)
        for who, (right, coding) in worth.items():
            if rng.random() < 0.8:
                says = who == "always" if right is None else keep if rng.random() < right else not keep
                rows.append((f"i{i}", who, "keep" if says else "exclude", (code if rng.random() < coding else rng.choice(CODES)) if says else None, "clash"))
    rows += [("bare", "a", "keep", None, ""), ("bare", "b", "keep", "", ""), ("gone", "a", None, "A.x", ""), (None, "a", "keep", "A.x", ""), ("gone", None, "keep", "A.x", "")]
    model = consensus.Reviews(spark.createDataFrame(rows, "item string, annotator string, decision string, code string, label string"))
    got = {r.item: r for r in model.result().collect()}
    assert got["bare"].keep and got["bare"].label is None and "gone" not in got
    decided = [got[i].keep == k for i, (k, _) in truth.items() if i in got]
    coded = [got[i].label == c for i, (k, c) in truth.items() if i in got and k and got[i].keep]
    votes = {}
    for i, _, says, code, _ in rows:
        if code and says:
            votes.setdefault(i, []).append(code)
    plurality = [max(sorted(set(votes[i])), key=votes[i].count) == c for i, (k, c) in truth.items() if i in got and k and got[i].keep and i in votes]
    assert np.mean(decided) > 0.93 and np.mean(coded) > 0.9 and np.mean(coded) > np.mean(plurality)
    kept = [i for i in truth if i in got and got[i].keep]
    assert np.mean([not truth[i][0] for i in kept]) < 0.06
    rel = {r.annotator: r for r in model.reliability().collect()}
    assert rel["flips"].p_null_right < 0.3 and rel["always"].p_null_right < 0.1 and rel["a"].p_label_right > rel["flips"].p_label_right and rel["never"].n_codes == 0 and rel["never"].p_label_right is None
    none = consensus.Reviews(spark.createDataFrame([], "item string, annotator string, decision string, code string"))
    assert none.result().count() == 0 and none.reliability().count() == 0


def test_dual_rises_and_scattered_codes_do_not_outweigh_the_null_class(spark):
    truth, rows = reviews(seed=3)
    model = consensus.Consensus(spark.createDataFrame(rows, "item string, annotator string, label string"))
    assert len(model.objective) > 2 and all(b >= a - 1e-9 * abs(a) for a, b in zip(model.objective, model.objective[1:]))
    got = {r.item: r.p_keep for r in model.result().collect()}
    kept = [i for i in got if got[i] > 0.5]
    assert np.mean([truth[i] == "" for i in kept]) < 0.08


def test_latest_review_stands(spark):
    t = dt.datetime(2025, 1, 1)
    reviewed = spark.createDataFrame([("c", "keep", None, "A", None, 1)], "candidate_id string, inclusion_decision_martin string, inclusion_decision_dominik string, final_code1_martin string, final_code1_dominik string, extra int")
    labels = [("c", "Rev ", "KEEP ", " B ", t), ("c", "rev", "exclude", None, t + dt.timedelta(1)), ("c", "rev", "exclude", None, t + dt.timedelta(1)), ("c", "x", "maybe", None, t), ("c", "y", "Keep", "C", None), (None, "y", "keep", "C", t)]
    labels = spark.createDataFrame(labels, "candidate_id string, reviewer string, inclusion_decision string, final_code1 string, reviewed_at timestamp_ntz")
    got = {(r.annotator, r.decision, r.code) for r in consensus.all_reviews(reviewed, labels).collect()}
    assert got == {("martin", "keep", "A"), ("rev", "exclude", None), ("y", "keep", "C")}


def test_krippendorff_by_hand(spark):
    rows = [("i1", "a"), ("i1", "a"), ("i2", "a"), ("i2", "b"), ("i3", "b"), ("i3", "b"), ("i3", "b"), ("i4", "a"), ("i5", None)]
    r = consensus.krippendorff(spark.createDataFrame(rows, "item string, label string").withColumn("g", F.lit(1)), ["g"], "item", "label").collect()[0]
    # coincidences over 7 paired labels: a 3, b 4; unlike pairs 2 of 7
    assert (r.n_items, r.n_labels) == (3, 7) and r.observed == pytest.approx(2 / 7) and r.alpha == pytest.approx(1 - (2 / 7) / (2 * 3 * 4 / (7 * 6)))
    same = consensus.krippendorff(spark.createDataFrame([("i", "a"), ("i", "a")], "item string, label string").withColumn("g", F.lit(1)), ["g"], "item", "label").collect()[0]
    assert same.alpha is None


# --- survivors ---


def test_survivors_equal_brute_force(spark):
    rng = random.Random(5)
    t0 = dt.datetime(2025, 1, 1)
    long_ = "a long enough passage of text that is cut somewhere in the middle"
    quotes = [None, "", "N/A", " none ", long_, long_[:40], long_[:10], "another text", "another ", "Ａnother text", long_ + "!"]
    rows = []
    for i in range(600):
        g = rng.randint(0, 120) if rng.random() < 0.6 else 500  # one hot group
        rows.append((i, f"s{g}", rng.choice(quotes), rng.choice(quotes), rng.choice(["A", "B", "zz", None, ""]), rng.choice(["pass", "fail", None]), t0 + dt.timedelta(minutes=rng.randint(0, 40)) if rng.random() < 0.95 else None, "clash"))
    rows += [(1000, None, "x", "x", "A", "pass", t0, ""), (1001, "alone", "x", "x", "A", "pass", t0, "")]
    df = spark.createDataFrame(rows, "record_id long, statement_id string, quote string, quote_en string, code1 string, qc_status string, received_at timestamp_ntz, g string").repartition(4)
    codebook = spark.createDataFrame([("A",), ("B",), (None,), ("A",)], "code string")
    got = {tuple(r) for r in survivor.statement_survivors(df, codebook).collect()}
    from attestra.llm.canon import canonical_texts

    want = set()
    for sid in {r[1] for r in rows} - {None}:
        group = [r for r in rows if r[1] == sid]
        if len(group) < 2:
            continue
        for name, at in (("quote", 2), ("quote_en", 3), ("code1", 4)):
            if name == "code1":
                ok = [r for r in group if r[4] in ("A", "B")]
            else:
                forms = {r[0]: canonical_texts([r[at]])[0] for r in group if r[at] and r[at].strip().lower() not in ("", "-", "none", "null", "n/a")}
                ok = [r for r in group if r[0] in forms and not any(o != forms[r[0]] and o.startswith(forms[r[0]]) for o in forms.values())]
            if ok:
                best = max(ok, key=lambda r: (r[5] != "fail", r[6] or dt.datetime.min, -r[0]))
                want.add((sid, name, best[0]))
    assert got == want
    assert survivor.statement_survivors(df.limit(0), codebook).count() == 0
    assert {r.field_name for r in survivor.statement_survivors(df, codebook.limit(0)).collect()} == {"quote", "quote_en"}


def test_layers_fill_what_the_front_lacks(spark):
    t = dt.datetime(2025, 1, 1)
    rows = [(1, "g", None, True, t + dt.timedelta(2)), (2, "g", "v", True, t + dt.timedelta(1)), (3, "g", "w", False, t + dt.timedelta(5)), (4, "g", "u", True, t)]
    df = spark.createDataFrame(rows, "id long, grp string, v string, trust boolean, at timestamp_ntz")
    r = survivor.best_values(df, "grp", "id", "at", {"v": F.col("v").isNotNull()}, F.col("trust")).collect()
    assert [(x.id, x.layer) for x in r] == [(2, 0)]
    cells = [dict(usable=u, trust=c, at=a, minus=0) for u, c, a in ((1, 1, 5), (1, 1, 4), (0, 1, 9), (0, 0, 3), (1, 0, 5))]
    one = spark.createDataFrame([(cells,)], "c array<struct<usable:int,trust:int,at:int,minus:int>>").select(survivor.dominance_layers(F.col("c")).alias("l")).collect()[0].l
    layer = {(x.c.usable, x.c.trust, x.c.at): x.layer for x in one}
    assert layer == {(1, 1, 5): 0, (0, 1, 9): 0, (1, 1, 4): 1, (1, 0, 5): 1, (0, 0, 3): 2}


def brute_layers(cells):
    """Layer by peeling: whoever is dominated only by shallower records."""
    beats = lambda a, b: all(x >= y for x, y in zip(a, b)) and any(x > y for x, y in zip(a, b))
    layer, left, depth = {}, set(range(len(cells))), 0
    while left:
        front = {i for i in left if not any(beats(cells[j], cells[i]) for j in left)}
        layer |= dict.fromkeys(front, depth)
        left, depth = left - front, depth + 1
    return layer


def test_built_records_are_filled_from_later_layers(spark):
    rng = random.Random(9)
    t0 = dt.datetime(2025, 1, 1)
    rows = [(i, f"g{rng.randint(0, 60)}", rng.choice([None, f"a{i}"]), rng.choice([None, None, f"b{i}"]), rng.random() < 0.5, t0 + dt.timedelta(minutes=rng.randint(0, 30))) for i in range(500)]
    rows += [(900, "x", "a", None, True, t0 + dt.timedelta(9)), (901, "x", None, "b", True, t0), (902, None, "a", "b", True, t0), (903, "y", None, None, False, None)]
    df = spark.createDataFrame(rows, "id long, grp string, a string, b string, trust boolean, at timestamp_ntz").repartition(3)
    fields = {f: F.col(f).isNotNull() for f in ("a", "b")}
    got = {(r.grp, r.field_name): (r.base, r.id, r.layer) for r in survivor.built_records(df, "grp", "id", "at", fields, F.col("trust")).collect()}
    deep = 0
    for g in {r[1] for r in rows} - {None}:
        latest = {}
        for r in rows:
            if r[1] == g:
                k = (r[2] is not None, r[3] is not None, r[4])
                key = (r[5] or dt.datetime.min, -r[0])
                latest[k] = max(latest.get(k, (key, r)), (key, r), key=lambda x: x[0])
        mine = [x[1] for x in latest.values()]
        layers = brute_layers([((r[2] is not None) + (r[3] is not None), r[5] or dt.datetime.min, r[4]) for r in mine])
        order = lambda i: (-layers[i], mine[i][4], mine[i][5] or dt.datetime.min, (mine[i][2] is not None) + (mine[i][3] is not None), -mine[i][0])
        base = max(range(len(mine)), key=order)
        for name, at in (("a", 2), ("b", 3)):
            have = [i for i in range(len(mine)) if mine[i][at] is not None]
            best = base if base in have else max(have, key=order) if have else None
            assert got[g, name] == (mine[base][0], mine[best][0] if best is not None else None, layers[best] if best is not None else None)
            deep += best is not None and layers[best] > 0
    assert deep > 0


def test_cut_short_over_partition_borders(spark):
    rng = random.Random(1)
    hot = ["common beginning of a very long passage " + "".join(rng.choices("ab", k=rng.randint(1, 9))) for _ in range(400)]
    values = sorted({("g", "quote", v) for v in hot} | {("g", "quote", v[: rng.randint(1, 50)]) for v in hot} | {("h", "quote", "ab"), ("h", "quote_en", "abc"), ("h", "quote", "")})
    df = spark.createDataFrame(values, "g string, field string, v string").repartition(6)
    want = {x for x in values if x[2] and any(y[:2] == x[:2] and y[2] != x[2] and y[2].startswith(x[2]) for y in values)}
    assert {tuple(r) for r in survivor.cut_short(df).collect()} == want
    assert survivor.cut_short(df.limit(0)).count() == 0


# --- prefix, quotas ---


def test_prefix_equals_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, "hot" if rng.random() < 0.5 else f"g{i % 7}", rng.randint(-(2**63), 2**63 - 1), rng.randint(0, 9)) for i in range(3000)]
    rows += [(5000 + i, "tied", 77, 2) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, grp string, key long, size long")
    budget = {"hot": 1234, "tied": 41, "g0": 0, "g1": 10**9, "g2": 1, "g3": 300}
    budgets = spark.createDataFrame(list(budget.items()), "grp string, budget long")
    got = {r.id for r in prefix.up_to_budget(df, budgets, ["grp"], "key", "id", "size").collect()}
    want = set()
    for g, b in budget.items():
        used = 0
        # buckets go by the unsigned top bits, the order within one by the signed key
        for i, _, _, size in sorted((r for r in rows if r[1] == g), key=lambda r: ((r[2] % 2**64) >> 52, r[2], r[0])):
            used += size
            if used > b or b == 0:
                break
            want.add(i)
    assert got == want
    assert prefix.up_to_budget(df.limit(0), budgets, ["grp"], "key", "id", "size").count() == 0


def brute_quotas(shares, available, total, floor=1):
    """The factor by bisection, then whole quotas by largest fraction."""
    shares = [max(0.0, x or 0.0) for x in shares]
    lo = [min(floor, a) for a in available]
    at = lambda k: [max(f, min(a, k * x)) for f, a, x in zip(lo, available, shares)]
    low, high = 0.0, 1e9
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(at(mid)) <= total else (low, mid)
    x = at(low)
    q = [int(v + 1e-6) for v in x]
    by = sorted(range(len(x)), key=lambda i: (-round(x[i] - q[i], 9), i))
    for i in by[: max(0, round(sum(x)) - sum(q))]:
        q[i] += q[i] < available[i]
    return q


def quotas(spark, shares, available, total, **more):
    df = spark.createDataFrame([(i, s, a) for i, (s, a) in enumerate(zip(shares, available))], "k int, share double, available long")
    return [r.quota for r in quota.allocate(df, ["k"], total, **more).orderBy("k").collect()]


def test_largest_remainder(spark):
    assert quotas(spark, [50.0, 30.0, 20.0], [100, 100, 100], 10) == [5, 3, 2]
    assert quotas(spark, [1.0, 1.0, 1.0], [9, 9, 9], 10) == [4, 3, 3]
    assert quotas(spark, [98.0, 1.0, 1.0], [100, 5, 0], 10) == [9, 1, 0]
    assert quotas(spark, [5.0, 5.0], [2, 100], 10) == [2, 8]
    assert quotas(spark, [5.0, 5.0], [2, 100], 10, redistribute=False) == [2, 5]
    assert quotas(spark, [None, -1.0, 0.0], [3, None, 0], 0) == [1, 0, 0]
    assert quotas(spark, [1.0, 1.0], [3, 4], 100) == [3, 4] and quotas(spark, [], [], 5) == []
    rng = random.Random(0)
    for _ in range(12):
        n = rng.randint(1, 8)
        shares, avail, total = [rng.random() for _ in range(n)], [rng.randint(0, 30) for _ in range(n)], rng.randint(n, 60)
        q = quotas(spark, shares, avail, total)
        assert q == brute_quotas(shares, avail, total) and sum(q) == min(total, sum(avail))


def test_quota_sample(spark):
    rows = [(f"c{i}", " EN" if i % 2 else "en ", "Both", 1) for i in range(40)] * 2 + [(f"d{i}", "fr", "both", 1) for i in range(3)] + [("n", None, "both", 1), (None, "en", "both", 1)]
    df = spark.createDataFrame(rows, "candidate_id string, language string, origin_type string, _key int")
    targets = spark.createDataFrame([("en", "both", 10), ("fr", "both", 5), ("ja", "both", 2), ("es", "both", None)], "language string, origin_type string, sample long")
    s = quota.QuotaSample(df, targets, ["language", "origin_type"], "sample", "candidate_id")
    report = {r.language: (r.target, r.available, r.quota, r.shortfall) for r in s.report().collect()}
    assert report == {"en": (10, 40, 10, 0), "fr": (5, 3, 3, 2), "ja": (2, 0, 0, 2), "es": (0, 0, 0, 0)}
    chosen = s.sample().collect()
    assert len(chosen) == 13 and len({r.candidate_id for r in chosen}) == 13
    assert {tuple(r) for r in chosen} == {tuple(r) for r in quota.QuotaSample(df.repartition(5), targets, ["language", "origin_type"], "sample", "candidate_id").sample().collect()}
    empty = quota.QuotaSample(df.limit(0), targets, ["language", "origin_type"], "sample", "candidate_id")
    assert empty.sample().count() == 0 and empty.report().count() == 4
    assert quota.QuotaSample(df, targets.limit(0), ["language", "origin_type"], "sample", "candidate_id").report().count() == 0


# --- mixes ---


def given(spark, leaves, total):
    df = spark.createDataFrame([(*path, w, c) for path, w, c in leaves], "domain string, language string, source string, weight double, capacity double")
    wanted = mixing.wants(df, mixing.PATH, total)
    out = {(r.domain, r.language, r.source): r.budget for r in mixing.budgets(wanted, mixing.PATH).collect()}
    shares = {(r.domain, r.language, r.source): (r.wanted, r.unmet) for r in wanted.collect()}
    return [round(out[path], 6) for path, _, _ in leaves], [shares[path] for path, _, _ in leaves]


def test_shortage_goes_to_siblings_first(spark):
    leaves = [(("d1", "en", "a"), 0.25, 100.0), (("d1", "en", "b"), 0.25, 5.0), (("d1", "fr", "a"), 0.25, 100.0), (("d2", "en", "a"), 0.25, 100.0)]
    out, shares = given(spark, leaves, 80.0)
    assert out == [35, 5, 20, 20]  # the sibling takes it all
    assert [tuple(round(x, 6) for x in s) for s in shares] == [(20, 0), (20, 15), (20, 0), (20, 0)]
    leaves[0] = (("d1", "en", "a"), 0.25, 22.0)
    assert given(spark, leaves, 80.0)[0] == [22, 5, 33, 20]  # then the next language of the domain
    leaves[2] = (("d1", "fr", "a"), 0.25, 25.0)
    assert given(spark, leaves, 80.0)[0] == [22, 5, 25, 28]
    assert given(spark, [(("a", "b", "c"), 1.0, 3.0)], 10.0)[0] == [3]
    assert given(spark, [], 5.0)[0] == []


def test_water_fill_equals_pouring(spark):
    rng = random.Random(6)
    for _ in range(6):
        rows = [(f"g{rng.randint(0, 2)}", i, rng.choice([0.0, rng.uniform(0, 20)]), rng.choice([0.0, rng.uniform(0.1, 3)])) for i in range(20)]
        pool = {f"g{k}": rng.uniform(0, 80) for k in range(3)}
        df = spark.createDataFrame([(*r, pool[r[0]]) for r in rows], "g string, i int, room double, weight double, pool double")
        got = {r.i: r.took for r in mixing.water_fill(df, ["g"], ["i"], "pool", "room", "weight").collect()}
        for g in pool:
            mine = {i: (room, w) for k, i, room, w in rows if k == g and room > 0 and w > 0}
            took, rest = dict.fromkeys(mine, 0.0), pool[g]
            while rest > 1e-9 and (open_ := [i for i in mine if mine[i][0] - took[i] > 1e-9]):
                all_w = sum(mine[i][1] for i in open_)
                pour = {i: min(mine[i][0] - took[i], rest * mine[i][1] / all_w) for i in open_}
                took = {i: took[i] + pour.get(i, 0.0) for i in mine}
                rest -= sum(pour.values())
            assert all(got[i] == pytest.approx(took.get(i, 0.0), abs=1e-6) for k, i, _, _ in rows if k == g)


def test_mix(spark):
    rng = random.Random(3)
    docs = [(i, rng.choice(["d", None]), rng.choice(["en", "fr"]), "big" if i % 3 else "small", rng.randint(1, 20), 7) for i in range(900)]
    docs += [(900, "d", "en", None, 50, 7), (901, "d", "en", "unused", 30, 7), (902, "d", "en", "big", 0, 7), (903, "d", "en", "big", None, 7), (None, "d", "en", "big", 5, 7), (0, *docs[0][1:])]
    df = spark.createDataFrame(docs, "doc_id long, domain string, language string, source string, n_tokens long, epochs int")
    targets = spark.createDataFrame([("big", 0.5, 2), ("small", 0.4, 3), ("absent", 0.1, 4), (None, 0.3, 1)], "source string, target_share double, max_repeats int")
    mix = mixing.SourceMix(df, targets)
    assert {r.source for r in mix.short_sources().collect()} == {"absent"}
    rows = mix.selection().collect()
    cap = {"big": 2, "small": 3}
    assert rows and all(1 <= r.copies <= cap[r.source] for r in rows) and len({r.doc_id for r in rows}) == len(rows)
    given = {s: sum(r.n_tokens * r.copies for r in rows if r.source == s) for s in cap}
    leaves = {(r.domain, r.language, r.source): r.budget for r in mix.leaves.collect()}
    assert mix.total - 20 < sum(given.values()) <= mix.total  # within one document of the budget
    for s in cap:
        want = sum(b for (_, _, x), b in leaves.items() if x == s)
        assert abs(given[s] - want) <= 20 * sum(k[2] == s for k in leaves)
    levels = {(r.level, r.domain, r.language): r for r in mix.levels().collect()}
    assert levels["total", None, None].given == sum(given.values()) and levels["total", None, None].wanted == pytest.approx(mix.total)
    assert sum(r.given for r in levels.values() if r.level == "domain") == sum(r.given for r in levels.values() if r.level == "language") == sum(given.values())
    assert sum(leaves.values()) == pytest.approx(mix.total, abs=len(leaves))
    report = {r.source: r for r in mix.report().collect()}
    assert report["absent"].given == 0 and report["absent"].short and not report["big"].short and report["big"].actual_share == pytest.approx(given["big"] / mix.total)
    assert {(r.doc_id, r.copies) for r in rows} == {(r.doc_id, r.copies) for r in mixing.SourceMix(df.repartition(7), targets).selection().collect()}
    nothing = mixing.SourceMix(df.limit(0), targets)
    assert nothing.selection().count() == 0 and nothing.report().count() == 3
    assert mixing.SourceMix(df, targets.limit(0)).selection().count() == 0
