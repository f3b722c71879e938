"""Text operators: canonical forms, near duplicates, languages, tokens, reading level."""

import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attestra.llm import bpe, canon, languages, neardup, readability


def brute_canon(text):
    """One code point after another, by the same tables."""
    t = canon.tables()
    out = []
    for ch in text.replace("\r\n", "\n"):
        c = int(t["target"][ord(ch)])
        out += [] if c == -1 else t["several"][ord(ch)] if c == -2 else [c]
    ccc = [int(t["ccc"][c]) for c in out]
    i = 0
    while i < len(out):
        j = i
        while j < len(out) and ccc[j]:
            j += 1
        order = sorted(range(i, j), key=lambda k: ccc[k])
        out[i:j], ccc[i:j] = [out[k] for k in order], [ccc[k] for k in order]
        i = max(j, i + 1)
    pairs = dict(zip(t["pair_keys"].tolist(), t["pair_to"].tolist()))
    made, base, last = [], None, 0
    for c, k in zip(out, ccc):
        if k and base is not None and (last == 0 or last < k) and (made[base] << 21 | c) in pairs:
            made[base] = pairs[made[base] << 21 | c]
            continue
        made.append(c)
        if k == 0:
            base, last = len(made) - 1, 0
        else:
            last = k
    return "".join(map(chr, made))


SAME = [("Ꮲ02", "P02"), ("ꓑ02", "P02"), ("ρ", "p"), ("a‚ b", "a, b"), ("Ｐ０２", "P02"), ("Р02", "P02"), ("P​02", "P02"), ("P\U0001d7e2\U0001d7e4", "P02"), ("café", "café"), ("ﬃx", "ffix"), ("a b", "a b"), ("ﾄﾞ", "ド"), ("ё", "ё"), ("ạ́", "ạ́"), ("x\r\ny", "x\ny"), ("‑", "-"), ("Й", "Й")]
UNLIKE = [("P02", "p02"), ("P02", "P2"), ("café", "cafe"), ("a b", "a\nb"), ("a,b", "a;b"), ("x²", "x2"), ("½", "1/2"), ("ab", "a b")]


@pytest.mark.parametrize("a,b", SAME)
def test_equal_looks(a, b):
    x, y = canon.canonical_texts([a, b])
    assert x == y


@pytest.mark.parametrize("a,b", UNLIKE)
def test_visible_differences_stay(a, b):
    x, y = canon.canonical_texts([a, b])
    assert x != y


def test_canonical_equals_brute_force_and_is_stable():
    rng = random.Random(4)
    pool = list("abeoxИй ёеA\n-") + ["́", "̈", "̣", "̧", "‍", "­", "ﬁ", "Ｗ", "é", "ﾊ", "ﾟ", "カ", "゙", "…", "한", "\U0001d54f", " ", "Ω"]
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 30))) for _ in range(400)] + ["", "́́a", "x" * 100_000 + "é"]
    forms = canon.canonical_texts(texts)
    assert forms == [brute_canon(t) for t in texts]
    assert canon.canonical_texts(forms) == forms
    assert canon.canonical_or_null([None, "", "Ａ"]) == [None, "", "A"]
    assert canon.canonical_texts([]) == []


def test_latin_text_matches_unicode_composition():
    words = ["Ångström", "naïve", "São", "Größe", "crème"]
    assert canon.canonical_texts([unicodedata.normalize("NFD", w) for w in words]) == words


def test_same_look_pairs(spark):
    rows = [(1, "g", "P02"), (2, "g", "Р02"), (3, "g", "P02"), (4, "h", "Ｐ02"), (5, "g", None), (6, "g", ""), (7, "g", "​"), (8, "g", "p02")]
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], "id long, grp string, v string, k1 string, raw int")
    got = {(r.id_a, r.id_b) for r in canon.same_look_pairs(df, "id", ["grp"], "v").collect()}
    assert got == {(1, 2), (2, 3), (6, 7)}
    assert canon.same_look_pairs(df.limit(0), "id", ["grp"], "v").count() == 0
    classes = {r.id: (r.class_id, r.rows, r.spellings) for r in canon.look_classes(df, "id", ["grp"], "v").collect()}
    assert set(classes) == {1, 2, 3, 4, 6, 7, 8} and classes[1] == classes[2] == classes[3] and classes[1][1:] == (3, 2) and classes[6][1:] == (2, 2) and classes[4][1:] == (1, 1)
    assert [r[0] for r in df.orderBy("id").select(canon.canonical(df.v)).collect()] == ["P02", "P02", "P02", "P02", None, "", "", "p02"]


# --- near duplicates ---


def jaccard(a, b):
    a, b = set(neardup.words_of(a)), set(neardup.words_of(b))
    return len(a & b) / len(a | b) if a and b else 0.0


def test_words():
    assert sorted(neardup.words_of("The the A1_b 銀行の預 日x")) == sorted(["the", "a1", "b", "銀行", "行の", "の預", "日x"])
    assert neardup.words_of("... -- ") == []


def near_fixture(seed=0):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        base = rng.sample(vocabulary, 30)
        rows.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            other = base[:]
            for _ in range(rng.randint(0, 4)):
                other[rng.randrange(len(other))] = rng.choice(vocabulary)
            rng.shuffle(other)
            rows.append(" ".join(other).upper() if rng.random() < 0.3 else " ".join(other))
    rows += ["same text here"] * 40 + [None, "", "N/A", "none", "...", "一二三四五六", "一二三四五六七", "Ｗ1 w2 w3", "w1 w2 w3", " ".join(f"z{i}" for i in range(70_000))]
    rng.shuffle(rows)
    return rows


def test_row_pairs_equal_brute_force(spark):
    rows = near_fixture()
    df = spark.createDataFrame([(i, t, None if i % 3 else "extra row text " + str(i), "clash") for i, t in enumerate(rows)], "rid long, q string, e string, text string").repartition(5)
    near = neardup.NearDuplicates(neardup.text_rows(df, "rid", ["q", "e"]), 0.7)
    got = {(r.a, r.b) for r in near.row_pairs(neardup.row_of_text(2)).collect()}
    holders = {"", "-", "none", "null", "n/a"}
    texts = {r.rid: [canon.canonical_texts([t])[0] for t in (r.q, r.e) if t and t.strip().lower() not in holders] for r in df.collect()}
    want = {(i, j) for i in texts for j in texts if i < j and any(jaccard(a, b) >= 0.7 for a in texts[i] for b in texts[j])}
    assert got == want
    out = near.rows(neardup.row_of_text(2)).collect()
    assert max(r.copies for r in out) == 40 and len({r.text_key for r in out}) == len(out)


def test_near_duplicates_of_nothing(spark):
    empty = spark.createDataFrame([], "text_key long, text string")
    near = neardup.NearDuplicates(empty)
    assert near.links.count() == 0 and near.row_pairs(neardup.row_of_text(1)).count() == 0
    only_null = spark.createDataFrame([(1, None), (2, "")], "text_key long, text string")
    assert neardup.NearDuplicates(only_null).rows(neardup.row_of_text(1)).count() == 0


def test_register_codes_follow_the_hash_and_split_tables():
    h = np.arange(1, 4000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    codes = neardup.register_codes(h, 3)
    assert ((codes.reshape(len(h), neardup.BUCKETS, 3) != neardup.EMPTY).sum(1) <= 1).all()  # one bucket of each hash
    for bucket in range(neardup.BUCKETS):
        x = neardup._mix(h, 0x9E3779B97F4A7C15)
        mine = codes[x >> np.uint64(62) == bucket, bucket * 3]
        order = np.argsort(x[x >> np.uint64(62) == bucket], kind="stable")
        assert (np.diff(mine[order].astype(int)) >= 0).all()
    lists = pa.array([list(range(50)), [7], list(range(30, 2000))], pa.list_(pa.int64()))
    whole = neardup._register_matrix(lists)
    kept, neardup.MAX_VOCABULARY = neardup.MAX_VOCABULARY, 64
    try:
        assert (neardup._register_matrix(lists) == whole).all()
    finally:
        neardup.MAX_VOCABULARY = kept


@pytest.mark.parametrize("shared,own", [(30, 10), (12, 3), (3, 1), (0, 20)])
def test_corrected_estimate_is_unbiased(shared, own):
    rng = np.random.default_rng(3)
    n, errors = shared + own, []
    for _ in range(80):
        both, rest = rng.integers(1, 2**63, shared, dtype=np.int64), rng.integers(1, 2**63, (2, own), dtype=np.int64)
        sets = pa.array([np.r_[both, o] for o in rest], pa.list_(pa.int64()))
        codes = neardup.small_codes(neardup._register_matrix(sets, 216)[:, :216])
        errors.append(neardup.similarity(codes[:1], codes[1:])[0] - shared / (n + own))
    assert abs(np.mean(errors)) < 0.025


def test_bands_find_similar_sets_as_often_as_stated():
    rng = np.random.default_rng(5)
    found = 0
    for _ in range(300):
        both, rest = rng.integers(1, 2**63, 28, dtype=np.int64), rng.integers(1, 2**63, (2, 6), dtype=np.int64)  # 28 of 40: 0.7
        a, b = neardup._register_matrix(pa.array([np.r_[both, o] for o in rest], pa.list_(pa.int64()))).reshape(2, neardup.BANDS, neardup.ROWS)
        found += bool((a == b).all(1).any())
    assert found / 300 > 0.95


def test_hot_band_keys_are_paired_in_blocks(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(40)]
    rows = [" ".join([*base, *(f"v{rng.randrange(10**6)}" for _ in range(2))]) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(rows)), "text_key long, text string")
    kept, neardup.HOT_RUN = neardup.HOT_RUN, 7
    try:
        keys = np.zeros(40, np.uint32)
        blob = keys.tobytes() + np.arange(40, dtype=np.uint16).tobytes()
        batch = pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([100]), pa.array([blob])], names=["part", "base", "blob"])
        blocks = list(neardup._equal_key_pairs(iter([batch])))
        assert all(b.column("a").null_count == b.num_rows for b in blocks)
        sides = [pa.RecordBatch.from_arrays([b.column("left"), b.column("right")], names=["left", "right"]) for b in blocks]
        got = [tuple(x) for b in neardup._block_pairs(iter(sides)) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        assert sorted(got) == [(i, j) for i in range(100, 140) for j in range(i + 1, 140)]
    finally:
        neardup.HOT_RUN = kept
    near = neardup.NearDuplicates(df, 0.7)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if jaccard(rows[i], rows[j]) >= 0.7}
    assert {(r.a, r.b) for r in near.row_pairs(neardup.row_of_text(1)).collect()} == want and len(want) == 60 * 59 // 2


def test_pairs_in_blocks(spark):
    from attestra.llm import pairs

    rng = random.Random(4)
    rows = sorted({(rng.choice(["hot", "hot", "a", "b"]), i) for i in range(300)})
    df = spark.createDataFrame(rows, "g string, id long")
    kept, pairs.CHUNK = pairs.CHUNK, 20
    try:
        got = [tuple(r) for r in pairs.within(df.union(df.limit(30)), pairs.sizes(df, ["g"]), ["g"]).collect()]
        assert sorted(set(got)) == sorted((i, j) for g, i in rows for h, j in rows if g == h and i < j)
        two = spark.createDataFrame([("hot", "a"), ("a", "b"), ("a", "none")], "x string, y string")
        got = [tuple(r) for r in pairs.between(two, df, pairs.sizes(df, ["g"]), ["x"], ["y"], ["g"]).collect()]
        assert sorted(got) == sorted((min(i, j), max(i, j)) for g, i in rows for h, j in rows if (g, h) in {("hot", "a"), ("a", "b")})
    finally:
        pairs.CHUNK = kept


# --- languages ---


def test_labels(spark):
    labels = ["en", "EN", "eng", "en-GB", "English", " pt_BR ", "ru/uk", "xx", "", None, "german", "fre", "jpn", "ja-JP", "spanish-MX", "e"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in labels], "v string").select(languages.label_language(F.col("v"))).collect()]
    assert got == ["en", "en", "en", "en", "en", "pt", None, None, None, None, "de", "fr", "ja", "ja", "es", None]


@pytest.fixture(scope="module")
def profiles(spark, small):
    from attestra.llm import queries

    return languages.Profiles(queries._prototypes(spark, "/root/testdata/sf0.01"))


def langs(profiles, text):
    return [(s, code) for s, code, _, _ in languages.judge(profiles, canon.canonical_or_null([text]), True)[0]]


def test_paragraphs_and_mixed_text(profiles):
    en = "The central bank extends the offline payment mode for merchants."
    de = "Der Pilotbericht verschiebt den Status als gesetzliches Zahlungsmittel mit wöchentlichen Berichten."
    uk = "Робоча група відкладає перевірку особи під час реєстрації у співпраці з банками."
    ru = "Надзорный орган публикует тарифы для торговых точек согласно записке."
    ja = "技術委員会は年末までに、疑わしい送金の監視を提案する。"
    assert langs(profiles, f"{en}\n\n \n{de}\r\n\r\n{uk}\n \n{ru}\n\n{ja}") == [(0, "en"), (1, "de"), (2, "uk"), (3, "ru"), (4, "ja")]
    assert set(langs(profiles, f"{en} {en} {de}")) == {(0, "en"), (0, "de")}
    assert set(langs(profiles, f"{ja}{ja} {en}")) == {(0, "ja"), (0, "en")}
    assert langs(profiles, f"{en} In Halphamar and Brenwaton. Quormaton.") == [(0, "en")]
    assert langs(profiles, "30 | 4915 | 1336 ... Zanten") == [] and langs(profiles, None) == [] and langs(profiles, " \n ") == []
    odd = en.replace("e", "е").replace("a", "­a")
    assert langs(profiles, f"{en} Shops trust {'x' * 60} it when it rains.") == [(0, "en")]
    assert langs(profiles, odd) == [(0, "en")]


def test_prototypes_are_bundled_again_three_times(monkeypatch):
    made, real = [], languages._bundle
    monkeypatch.setattr(languages, "_bundle", lambda *a: made.append(1) or real(*a))
    languages.train([("en", "The bank keeps the ledger of all payments.")])
    assert len(made) == 1 + 3


def test_seeds_alone_separate_languages():
    p = languages.Profiles(languages.train([]))
    assert [x[0][1] for x in languages.judge(p, ["the one that they have for you and not the other", "el que no se como para los una del"], False)] == ["en", "es"]


def test_held_out_accuracy(spark, profiles):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) > 200").collect()
    table = {n: c for c, names in languages.NAMES.items() for n in (c, *names)}
    right = total = 0
    for r in rows:
        code = table.get((r.lang or "").strip().lower().split("-")[0])
        found = {c for _, c in langs(profiles, r.text)}
        if code and len(found) == 1:
            total += 1
            right += found == {code}
    assert total > 40 and right / total > 0.8  # the rest carry a wrong label


def test_detect_handles_nulls_and_empty(spark, profiles):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "You can use the app each day.", "x")], "k long, t string, found string")
    out = {r.k: r.found for r in languages.detect(df, profiles.prototypes, ["k"], "t", True).collect()}
    assert out[1] == [] and out[2] == [] and out[3][0].language == "en" and 0 < out[3][0].confidence <= 1
    assert languages.detect(df.limit(0), profiles.prototypes, ["k"], "t", True).count() == 0


# --- tokens ---


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def test_ids_equal_the_library(spark, small):
    rng = random.Random(2)
    odd = ["", " ", "a", "aaaaaaaaaaaaaaaa" * 40, "<|endoftext|> x", "don't  we'll\n\n\t x", "👩‍💻 café ｆｕｌｌ", "\x00\x01", "0123456789" * 30, "日本語のテキスト", "-" * 500]
    texts = odd + ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x2FFF), rng.randint(0x1F300, 0x1F6FF)])) for _ in range(60)) for _ in range(50)]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)] + [(-1, None, [1])], "doc_id long, text string, ids array<int>")
    got = {r.doc_id: r.ids for r in bpe.encode(df).collect()}
    assert got[-1] == [] and got[0] == []
    for i, e in enumerate(library().encode_batch(texts, add_special_tokens=False)):
        assert got[i] == e.ids
    counts = {r.doc_id: r.n_tokens for r in bpe.with_token_counts(df.select("doc_id", "text")).collect()}
    assert counts == {k: len(v) for k, v in got.items()}
    assert bpe.encode(df.limit(0)).count() == 0


def test_long_pieces_have_the_ids_of_short_ones():
    rng = random.Random(7)
    v = bpe.Vocabulary(bpe.vocabulary_lines())
    for size in (2, 3, 50, 900):
        piece = bytes(rng.choice(b"abcdeeeethiionst ") for _ in range(size))
        assert v._merge_long(piece).tolist() == v.merge([piece])[0].tolist()
    long_ = "".join(rng.choice("abcdeeeethiionst") for _ in range(5000)) + "é" * 700 + "a" * 3000
    assert bpe.Encoder(bpe.vocabulary_lines()).encode([long_])[0].tolist() == library().encode(long_, add_special_tokens=False).ids


def test_whole_table_round_trip(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    t = library()
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    got = {r.doc_id: r.ids for r in bpe.encode(df).collect()}
    assert all(t.decode(got[k]) == v for k, v in texts.items())


def test_piece_memory_restarts():
    e = bpe.Encoder(bpe.vocabulary_lines())
    kept, bpe.KEPT_PIECES = bpe.KEPT_PIECES, 3
    try:
        a = e.encode(["one two three four five six"])[0].tolist()
        assert e.encode(["one two three four five six"])[0].tolist() == a
    finally:
        bpe.KEPT_PIECES = kept


# --- reading level ---


def test_measures_equal_a_plain_computation():
    text = "You can pay. It is easy, and cheap!\n\nNotwithstanding the proportionality of methodologies, jurisdictions circumscribe programmability; why?"
    at, m = readability.measure_matrix(["", text, "123 ..."], readability.Words())
    assert at.tolist() == [1]
    words = readability.WORD.findall(text)
    k = len(readability.MEASURES)
    assert m[0, 0] == pytest.approx(np.mean([len(w) for w in words]), rel=1e-5)
    assert m[0, 1] == pytest.approx(np.mean([len(w) >= 8 for w in words]), rel=1e-5)
    first, second = text.split("\n\n")
    per = [np.mean([len(w) for w in readability.WORD.findall(p)]) for p in (first, second)]
    weights = [len(readability.WORD.findall(p)) for p in (first, second)]
    assert m[0, k] == pytest.approx(per[0] if weights[0] >= 0.25 * sum(weights) else per[1], rel=1e-5)
    assert m[0, 3 * k] == pytest.approx(per[1], rel=1e-5)


def test_boosted_trees_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5))
    y = np.where(x[:, 1] > 0, 2.0, 1.0) + (x[:, 3] > 0.5)
    model = readability.BoostedTrees(x[:400], y[:400])
    assert np.abs(model.predict(x[400:]) - y[400:]).mean() < 0.1
    knots, values = readability.isotonic(np.array([1.0, 2, 3, 4]), np.array([1.0, 3, 2, 4]))
    assert values.tolist() == [1, 2.5, 4] and (np.diff(knots) > 0).all()
    assert readability.BoostedTrees(np.zeros((0, 5)), np.zeros(0)).predict(x[:2]).tolist() == [2.0, 2.0]
    flat = readability.GradeModel(np.zeros((50, 3)), np.full(50, 2.0), ["s"] * 50)
    assert flat.bands(flat.calibrate(flat.trees.predict(np.zeros((2, 3))))).tolist() == [2, 2]


def test_accuracy_of_held_out_sources_is_honest():
    rng = np.random.default_rng(1)
    x, noise = rng.normal(size=(300, 4)), rng.integers(1, 4, 300).astype(float)
    model = readability.GradeModel(x, noise, [f"s{i % 6}" if i % 7 else None for i in range(300)])
    assert model.cv_accuracy < 0.5  # nothing to learn: about a third
    assert sum(n for _, n, _ in model.cv_sources) == 300 and {s for s, _, _ in model.cv_sources} == {None, *(f"s{i}" for i in range(6))}
    assert sum(r for _, _, r in model.cv_sources) == round(model.cv_accuracy * 300)


def test_graded_documents(spark, profiles):
    plain = "You can use the app each day. Bakers use cash. Is it cheap? Yes, it is easy and free. You can pay a bus fare. Families hold the rest at home. "
    hard = "Notwithstanding the extraterritorial programmability of asymmetries, the oversight substantiates that fiduciary jurisdictions, insofar as they presuppose the confidentiality of counterparties, ought to be circumscribed. "
    docs = [(i, f"s{i % 4}", (plain if i % 2 else hard) * (3 + i % 5), 1) for i in range(80)] + [(900, None, "Too short.", 1), (901, "s1", None, 1), (902, "s1", "", 1), (903, "s1", "El banco central examina el anonimato de los pagos pequeños con una clara mayoría. " * 9, 1)]
    docs = spark.createDataFrame(docs, "doc_id long, source string, text string, band int")
    labels = spark.createDataFrame([(i, f"r{k}", 1 if i % 2 else 3) for i in range(60) for k in range(2)] + [(0, "bad", None), (1, "bad", 9), (5555, "r", 1)], "doc_id long, rater string, band int")
    found, model = readability.graded(docs, labels, profiles.prototypes)
    got = {r.doc_id: r.band for r in found.collect()}
    assert set(got) == set(range(80)) and all(b == (1 if i % 2 else 3) for i, b in got.items()) and model.cv_accuracy == 1.0
    none, model = readability.graded(docs, labels.limit(0), profiles.prototypes)
    assert {r.band for r in none.collect()} == {2} and model.cv_accuracy is None
    assert readability.graded(docs.limit(0), labels, profiles.prototypes)[0].count() == 0
