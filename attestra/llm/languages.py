"""Problem 2: the language of texts, paragraphs and documents.

Method: hyperdimensional profiles. Every letter has a random bipolar vector; an n-gram
is the product of its letters' vectors, each rotated by its place; words and texts are
sums (bundles) of n-gram vectors, and languages are compared by the cosine with
prototype bundles. Prototypes are trained here: seeded by common words, bundled from a
bounded sample of labelled documents, and re-bundled from the sentences on which
label and profile agree, as labels are at times wrong.

Scale: the cosine is linear in the bundle, so the dot product of an n-gram with all
prototypes is computed once, words remember their sums, and a text costs a lookup per
word; no shuffle. Only the prototypes (8 x DIMENSIONS floats) are shipped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.canon import canonical_or_null, canonical_texts
from attestra.llm.prefix import up_to_budget

LANGUAGES = ("en", "es", "fr", "de", "pt", "ru", "uk", "ja")
# Three-letter codes and English names.
NAMES = {
    "en": ("eng", "english"), "es": ("spa", "spanish"), "fr": ("fra", "fre", "french"), "de": ("deu", "ger", "german"),
    "pt": ("por", "portuguese"), "ru": ("rus", "russian"), "uk": ("ukr", "ukrainian"), "ja": ("jpn", "japanese"),
}
# Common words that seed the prototypes where labelled text is scarce.
SEEDS = {
    "en": "the of and to in is that for it with as on by this are be from or which at an not have has was their been will can would could should than into under between before after while because however without against according during through where when what they we you our your other most more such than its",
    "es": "el la los las de del y en que a un una por con para no se su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante según contra bajo ante esto antes algunos qué unos otro otras mismo tanto cada será está son fue año años banco",
    "fr": "le la les de des du et en que un une pour dans qui sur au aux avec ne se pas plus par ce cette ces sont est été son sa ses leur leurs mais ou où comme nous vous ils elle elles sans sous entre avant après contre selon pendant depuis très aussi même tout tous toute être avoir fait peut année banque",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum haben nur oder aber vor zur bis mehr durch man sein wurde unter gegen zwischen während ohne laut seit weil jedoch",
    "pt": "o a os as de do da dos das e em que um uma por com para não se na no nas nos ao à como mais mas foi seu sua ou quando muito já está eu também só pelo pela até isso ela entre depois sem mesmo aos seus quem nas me esse eles você essa num nem suas meu às minha numa pelos são será banco ano segundo contra",
    "ru": "и в не на я быть он с что а по это она этот к но они мы весь который из у то за свой от со для о же год такой тот или если только его её при были было есть до также после через между против согласно более можно нужно без под над время чтобы банк как так их все вы бы уже ещё это этих система",
    "uk": "і в не на я бути він з що а до це вона цей та але вони ми який із у то за свій від зі для про ж рік такий той або якщо тільки його її при були було є також після через між проти згідно більше можна треба без під над час щоб банк як так їх усі ви б вже ще ці цих система й місті",
    "ja": "これはその日本の銀行について、ある。ことができるとして、されている。という。により、および、または、ための、ものとする。において、から、まで、なければならない。しかし、ています。である。いる。した。する。います。ません。でした。",
}
DIMENSIONS = 16384
GRAM, WHOLE_WORD = 3, 10
#: Labelled documents used per language, and the longest that is used.
TRAIN_DOCS, TRAIN_CHARS = 300, 20_000
#: Vectors of n-grams held at once.
BLOCK = 512
#: A sentence of another language than its paragraph's needs so many words and so much more score per root of n-gram.
MIN_WORDS, MARGIN = 3, 0.055
#: Of the softmax that turns cosines into a confidence.
SHARPNESS = 60
KEPT_WORDS = 150_000
BLANK_LINES = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])\s*")
WORD = re.compile(r"[^\W\d_]+")
JAPANESE = re.compile("[぀-ヿㇰ-ㇿ㐀-䶿一-鿿]")
NOT_PROSE = re.compile(r"https?://\S+|www\.\S+|\S+@\S+")


def label_language(label: Column) -> Column:
    """The language a label names by code, code with region or English name, in any case; else null."""
    clean = F.lower(F.trim(label))
    out = F.lit(None).cast("string")
    for code, names in NAMES.items():
        out = F.when(clean.rlike(rf"^({code}|{names[0]}|{'|'.join(names)})([-_][a-z0-9]+)*$"), F.lit(code)).otherwise(out)
    return out


def paragraphs(text: str) -> list[str]:
    """Pieces between blank lines; empty pieces are not counted."""
    return [p for p in BLANK_LINES.split(text.replace("\r\n", "\n").replace("\r", "\n")) if p.strip()]


def words_of(sentence: str) -> list[str]:
    """Lower-case runs of letters; neighbouring pairs where a run holds kana or kanji."""
    found = WORD.findall(sentence.lower())
    if not sentence.isascii() and JAPANESE.search(sentence):
        out = []
        for w in found:
            out += [w[i : i + 2] for i in range(len(w) - 1)] if JAPANESE.search(w) and len(w) > 1 else [w]
        return out
    return found


def letter_vector(letter: str) -> np.ndarray:
    """Random bipolar vector of a letter, the same everywhere."""
    bits = np.random.Generator(np.random.PCG64(xxhash.xxh3_64_intdigest(letter.encode("utf-8", "surrogatepass")))).integers(0, 2, DIMENSIONS, dtype=np.int8)
    return bits * 2 - 1


def grams(word: str) -> list[str]:
    """Distinct letter trigrams of the word between blanks, and a short word as a whole (a letter run counts once)."""
    padded = f" {word} "
    out = list(dict.fromkeys(padded[i : i + GRAM] for i in range(len(padded) - GRAM + 1)))
    return out + [padded] if GRAM < len(padded) <= WHOLE_WORD + 2 else out


def gram_vectors(some: list[str], letters: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones((len(some), DIMENSIONS), dtype=np.int8)
    for row, gram in zip(out, some):
        for place, letter in enumerate(gram):
            if (key := (letter, place)) not in letters:
                if len(letters) > 1_500:
                    letters.clear()
                letters[key] = np.roll(letter_vector(letter), place)
            np.multiply(row, letters[key], out=row)
    return out


def _dots(some: list[str], prototypes: np.ndarray, letters: dict) -> np.ndarray:
    """Products of n-gram vectors with the prototypes, a block of vectors at a time."""
    out = np.empty((len(some), len(prototypes)), dtype=np.float32)
    for at in range(0, len(some), BLOCK):
        out[at : at + BLOCK] = gram_vectors(some[at : at + BLOCK], letters).astype(np.float32) @ prototypes.T / np.sqrt(DIMENSIONS)
    return out


def _grown(table: np.ndarray, rows: int) -> np.ndarray:
    while rows > len(table):
        table = np.concatenate([table, np.zeros_like(table)])
    return table


class Profiles:
    """Prototypes (languages x dimensions, unit length, centred) and what words score against them."""

    def __init__(self, prototypes: np.ndarray):
        self.prototypes = prototypes.astype(np.float32)
        self.letters: dict = {}
        self._reset()

    def _reset(self) -> None:
        self.numbers: dict[str, int] = {}
        self.grams: dict[str, int] = {}
        self.scores = np.zeros((1024, len(LANGUAGES) + 1), dtype=np.float32)  # the last column counts n-grams
        self.gram_scores = np.zeros((1024, len(LANGUAGES)), dtype=np.float32)

    def learn(self, words: list[str]) -> None:
        """Scores of words not known yet."""
        own = [grams(w) for w in words]
        new = [g for g in dict.fromkeys(g for o in own for g in o) if g not in self.grams]
        first, at = len(self.grams), len(self.numbers)
        self.gram_scores = _grown(self.gram_scores, first + len(new))
        self.gram_scores[first : first + len(new)] = _dots(new, self.prototypes, self.letters)
        self.grams.update(zip(new, range(first, first + len(new))))
        sizes = np.array([len(o) for o in own])
        flat = np.array([self.grams[g] for o in own for g in o])
        self.scores = _grown(self.scores, at + len(words))
        self.scores[at : at + len(words), :-1] = np.add.reduceat(self.gram_scores[flat], np.r_[0, np.cumsum(sizes)[:-1]], axis=0)
        self.scores[at : at + len(words), -1] = sizes
        self.numbers.update(zip(words, range(at, at + len(words))))

    def sentences(self, sentences: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sum of the words' scores, number of n-grams and number of words of each sentence."""
        if max(len(self.numbers), len(self.grams)) > KEPT_WORDS:
            self._reset()
        known = self.numbers
        lists = [words_of(s) for s in sentences]
        if new := list(dict.fromkeys(w for ws in lists for w in ws if w not in known)):
            self.learn(new)
        counts = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        flat = [known[w] for ws in lists for w in ws]
        out = np.zeros((len(sentences), len(LANGUAGES) + 1))
        full = np.flatnonzero(counts)
        if len(full):
            out[full] = np.add.reduceat(self.scores[np.array(flat)].astype(np.float64), np.r_[0, np.cumsum(counts[full])[:-1]], axis=0)
        return out[:, :-1], out[:, -1], counts


def _bundle(counts: np.ndarray, known: list[str]) -> np.ndarray:
    """Prototypes from counts (languages x n-grams): n-grams bundled by how much more they are a language's own than the average language's; unit length."""
    rate = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    used = np.flatnonzero(counts.sum(0))
    weight = (rate[:, used] / rate[:, used].sum(0) - 1 / len(LANGUAGES)) * np.minimum(1, counts[:, used].sum(0) / 3)
    letters: dict = {}
    out = np.zeros((len(LANGUAGES), DIMENSIONS), dtype=np.float32)
    for at in range(0, len(used), BLOCK):
        out += weight[:, at : at + BLOCK].astype(np.float32) @ gram_vectors([known[g] for g in used[at : at + BLOCK]], letters).astype(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def train(samples: list[tuple[str, str]], rounds: int = 3) -> np.ndarray:
    """Prototypes from (language, text) samples whose labels may be wrong; without samples from the seeds alone. All n-grams of the samples count."""
    seeds = [[canonical_texts([w])[0] for w in words_of(SEEDS[code].lower())] for code in LANGUAGES]
    texts = canonical_texts([t for _, t in samples])
    pieces = [(LANGUAGES.index(code), ws) for (code, _), t in zip(samples, texts) for p in paragraphs(t) for s in SENTENCE.split(p) if len(ws := words_of(s)) >= MIN_WORDS]
    number = {w: i for i, w in enumerate(dict.fromkeys([*(w for ws in seeds for w in ws), *(w for _, ws in pieces for w in ws)]))}
    own = [grams(w) for w in number]
    known = list(dict.fromkeys(g for o in own for g in o))
    place = {g: i for i, g in enumerate(known)}
    gram_of = np.array([place[g] for o in own for g in o])
    sizes = np.array([len(o) for o in own])
    starts = np.r_[0, np.cumsum(sizes)[:-1]]

    def counted(words: np.ndarray) -> np.ndarray:
        times = np.bincount(words, minlength=len(number))
        return np.bincount(gram_of, weights=np.repeat(times, sizes), minlength=len(known))

    base = np.stack([counted(np.array([number[w] for w in ws])) for ws in seeds])
    prototypes = _bundle(base, known)
    if not pieces:
        return prototypes
    flat = np.array([number[w] for _, ws in pieces for w in ws])
    length = np.array([len(ws) for _, ws in pieces])
    code = np.array([c for c, _ in pieces])
    for _ in range(rounds):
        words = np.add.reduceat(_dots(known, prototypes, {})[gram_of].astype(np.float64), starts, axis=0)
        best = np.add.reduceat(words[flat], np.r_[0, np.cumsum(length)[:-1]], axis=0).argmax(1)
        agreed = np.repeat(np.where(best == code, code, -1), length)
        prototypes = _bundle(base + np.stack([counted(flat[agreed == c]) for c in range(len(LANGUAGES))]), known)
    return prototypes


def labelled_sample(docs: DataFrame, id_col: str, text_col: str, label_col: str) -> list[tuple[str, str]]:
    """At most TRAIN_DOCS labelled texts of each language, by smallest hash."""
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), label_language(F.col(label_col)).alias("code"))
    named = named.where((F.length("text") >= 40) & (F.length("text") <= TRAIN_CHARS) & F.col("code").isNotNull())
    keys = named.select("id", "code", F.xxhash64(F.lit("train"), F.col("id").cast("string")).alias("key"), F.lit(1).cast("long").alias("one"))
    budget = docs.sparkSession.createDataFrame([(c, TRAIN_DOCS) for c in LANGUAGES], "code string, budget long")
    chosen = up_to_budget(keys, budget, ["code"], "key", "id", "one").select("id", "code")
    # at most len(LANGUAGES) * TRAIN_DOCS ids, whatever the corpus
    rows = named.drop("code").join(F.broadcast(chosen), "id").select("code", "text", "id").collect()
    return [(r.code, r.text) for r in sorted(rows, key=lambda r: (r.code, str(r.id)))]


def judge(profiles: Profiles, texts: list[str | None], by_paragraph: bool) -> list[list[tuple[int, str, float, int]]]:
    """(segment, language, confidence, words) of each text; canonical texts in."""
    owner, segment, sentences = [], [], []
    for i, text in enumerate(texts):
        if not text:
            continue
        for k, paragraph in enumerate(paragraphs(text) if by_paragraph else [text]):
            if "://" in paragraph or "@" in paragraph or "www." in paragraph:
                paragraph = NOT_PROSE.sub(" ", paragraph)
            for s in SENTENCE.split(paragraph.replace("\n", " ")):
                if s:
                    owner.append(i)
                    segment.append(k)
                    sentences.append(s)
    out: list[list] = [[] for _ in texts]
    if not sentences:
        return out
    scores, size, n = profiles.sentences(sentences)
    where = np.array(owner, dtype=np.int64) << 32 | np.array(segment, dtype=np.int64)
    starts = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
    total, words = np.add.reduceat(scores, starts, axis=0), np.add.reduceat(n, starts)
    main = np.repeat(total.argmax(1), np.diff(np.r_[starts, len(where)]))
    at = np.arange(len(where))
    own = scores.argmax(1)
    root = np.sqrt(np.maximum(size, 1))
    other = (own != main) & (n >= MIN_WORDS) & (scores[at, own] - scores[at, main] > MARGIN * root)
    grams_in = np.add.reduceat(size, starts)
    ends = np.r_[starts[1:], len(where)]
    mixed = np.logical_or.reduceat(other, starts)
    first = total.argmax(1)
    sure = _confidence(total, grams_in)[np.arange(len(starts)), first]
    for j, (a, code, c, k) in enumerate(zip(starts.tolist(), first.tolist(), sure.tolist(), words.tolist())):
        if k < MIN_WORDS:
            continue
        if not mixed[j]:
            out[owner[a]].append((segment[a], LANGUAGES[code], c, k))
            continue
        part = slice(a, int(ends[j]))
        spoken = np.where(other[part], own[part], code)
        for language in dict.fromkeys([code, *spoken.tolist()]):
            mine = spoken == language
            if (k := int(n[part][mine].sum())) >= MIN_WORDS:
                c = _confidence(scores[part][mine].sum(0)[None], size[part][mine].sum()[None])[0, language]
                out[owner[a]].append((segment[a], LANGUAGES[language], float(c), k))
    return out


def _confidence(scores: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Softmax of the cosines of bundles of ``size`` n-grams."""
    e = np.exp(SHARPNESS * (scores - scores.max(1, keepdims=True)) / np.sqrt(np.maximum(size, 1))[:, None])
    return e / e.sum(1, keepdims=True)


def detect(rows: DataFrame, prototypes: np.ndarray, keys: list[str], text_col: str, by_paragraph: bool) -> DataFrame:
    """Adds ``found``: array of (segment, language, confidence, words); empty for null texts and texts without language."""
    shipped = rows.sparkSession.sparkContext.broadcast(prototypes.astype(np.float32))
    kind = pa.list_(pa.struct([("segment", pa.int32()), ("language", pa.string()), ("confidence", pa.float64()), ("words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(shipped.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                found = judge(profiles, canonical_or_null(batch.column(batch.num_columns - 1).to_pylist()), by_paragraph)
                out = pa.array([[dict(zip(("segment", "language", "confidence", "words"), x)) for x in f] for f in found], kind)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], out], names=[*keys, "found"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys) + ", found array<struct<segment int, language string, confidence double, words int>>"
    return rows.select(*keys, F.col(text_col).alias("_text")).mapInArrow(run, schema)
