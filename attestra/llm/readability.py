"""Problem 9: how demanding the text of each document is.

Method: gradient-boosted regression trees over the distributions, across a document's
paragraphs, of length, vocabulary, syntax and cohesion measures. The trees are trained
here on labelled documents (a bounded sample); predictions are cross-validated with
whole sources held out, and the cross-validated predictions set the isotonic
calibration and the cuts between bands. The accuracy reported for a source leaves its own
predictions out of calibration and cuts as well.

Scale: measures and predictions are one narrow pass without a shuffle; the driver sees
at most MAX_LABELLED rows of measures.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm import languages
from attestra.llm.canon import canonical_or_null
from attestra.tables import materialize

#: Labelled documents used for training, at most (by smallest hash).
MAX_LABELLED = 20_000
MIN_WORDS = 60
TREES, DEPTH, RATE, BINS, MIN_LEAF, FOLDS = 120, 3, 0.1, 32, 8, 5
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
VOWELS = re.compile(r"[aeiouyAEIOUY]+")
# English function words and connectives, for the measures of syntax and cohesion.
COMMON = frozenset("the a an of to in and or is are it you we he she they this that for on at with by as be do not if can will my your our his her its no yes so but from have has get use".split())
SUBORDINATE = frozenset("which whose whom that although though because unless while whereas insofar notwithstanding however therefore thereby whereby irrespective until since whether if when".split())
MEASURES = ("word_length", "long", "very_long", "syllables", "sentence_words", "sentence_spread", "commas", "stops", "questions", "common", "subordinate", "variety", "overlap", "short")


class Words(dict):
    """Number of each word and, in ``table``, its measures: letters, 8 or more, 12 or more, syllables, common, subordinate, 4 or fewer."""

    def __init__(self):
        self.table = np.zeros((1024, 7), dtype=np.float32)

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        if n >= len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        k = len(word)
        self.table[n] = (k, k >= 8, k >= 12, len(VOWELS.findall(word)), word in COMMON, word in SUBORDINATE, k <= 4)
        return n


def measure_matrix(texts: list[str], words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the texts that have a word, and for each mean and quartiles of its paragraphs' measures, weighted by words."""
    if len(words) > languages.KEPT_WORDS:
        words.clear()
    number = words.__getitem__
    owner, extra, sentence_sizes, sentence_counts, flat = [], [], [], [], []
    for i, text in enumerate(texts):
        for paragraph in languages.paragraphs(text):
            sentences = [ws for s in languages.SENTENCE.split(paragraph.lower().replace("\n", " ")) if (ws := WORD.findall(s))]
            if not sentences:
                continue
            content, overlap, kinds = None, 0.0, set()
            for ws in sentences:
                sentence_sizes.append(len(ws))
                flat += map(number, ws)
                own = set(ws)
                kinds |= own
                own -= COMMON
                if content is not None and own:
                    overlap += len(own & content) / len(own)
                content = own
            owner.append(i)
            sentence_counts.append(len(sentences))
            count = paragraph.count
            extra.append((count(","), count(";") + count(":"), count("?"), len(kinds), overlap / max(1, len(sentences) - 1)))
    if not owner:
        return np.zeros(0, np.int64), np.zeros((0, 4 * len(MEASURES)), np.float32)
    k = np.array(sentence_counts)
    size = np.array(sentence_sizes, dtype=np.float64)
    at = np.r_[0, np.cumsum(k)[:-1]]
    n = np.add.reduceat(size, at)
    sums = np.add.reduceat(words.table[np.array(flat)].astype(np.float64), np.r_[0, np.cumsum(n)[:-1]].astype(np.int64), axis=0) / n[:, None]
    mean = n / k
    spread = np.sqrt(np.maximum(np.add.reduceat(size * size, at) / k - mean * mean, 0))
    commas, stops, questions, kinds, overlap = np.array(extra, dtype=np.float64).T
    values = np.stack([sums[:, 0], sums[:, 1], sums[:, 2], sums[:, 3], mean, spread, commas / n, stops / n, questions / k, sums[:, 4], sums[:, 5], kinds / n, overlap, sums[:, 6]], 1)
    doc, first = np.unique(np.array(owner), return_index=True)
    which = np.repeat(np.arange(len(doc)), np.diff(np.r_[first, len(owner)]))
    total = np.add.reduceat(n, first)
    before = np.r_[0, np.cumsum(total)[:-1]]
    parts = [np.add.reduceat(values * n[:, None], first, axis=0) / total[:, None]]
    sorted_ = [np.lexsort((values[:, m], which)) for m in range(values.shape[1])]
    for q in (0.25, 0.5, 0.75):  # the value at which the running words of a text reach the share
        parts.append(np.stack([values[o[np.searchsorted(np.cumsum(n[o]), before + q * total - 1e-6)], m] for m, o in enumerate(sorted_)], 1))
    return doc, np.concatenate(parts, 1).astype(np.float32)


class BoostedTrees:
    """Least-squares gradient boosting over binned columns; trees of fixed depth kept as arrays."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.base = float(y.mean()) if len(y) else 2.0
        self.features, self.cuts, self.leaves = [], [], []
        if not len(y):
            return
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], 1)
        predicted = np.full(len(y), self.base)
        columns = np.arange(x.shape[1]) * BINS
        flat = binned + columns[None, :]
        for _ in range(TREES):
            rest = y - predicted
            node = np.zeros(len(y), dtype=np.int64)
            features, cuts = np.zeros(2**DEPTH - 1, dtype=np.int64), np.full(2**DEPTH - 1, np.inf)
            for level in range(DEPTH):
                first, nodes = 2**level - 1, 2**level
                index = ((node[:, None] * (x.shape[1] * BINS)) + flat).ravel()
                size = nodes * x.shape[1] * BINS
                n = np.bincount(index, minlength=size).reshape(nodes, x.shape[1], BINS).cumsum(2)
                s = np.bincount(index, weights=np.repeat(rest, x.shape[1]), minlength=size).reshape(nodes, x.shape[1], BINS).cumsum(2)
                total_n, total_s = n[:, :, -1:], s[:, :, -1:]
                right_n = total_n - n
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = s**2 / n + (total_s - s) ** 2 / right_n - total_s**2 / total_n
                gain = np.where((n >= MIN_LEAF) & (right_n >= MIN_LEAF), gain, -1.0)
                best = gain.reshape(nodes, -1).argmax(1)
                f, b = best // BINS, best % BINS
                good = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-9
                features[first : first + nodes] = f
                cuts[first : first + nodes] = [self.edges[i][j] if ok and j < len(self.edges[i]) else np.inf for i, j, ok in zip(f, b, good)]
                node = node * 2 + (x[np.arange(len(y)), f[node]] >= cuts[first + node])
            n = np.bincount(node, minlength=2**DEPTH)
            leaf = RATE * np.bincount(node, weights=rest, minlength=2**DEPTH) / (n + 1)
            predicted += leaf[node]
            self.features.append(features)
            self.cuts.append(cuts)
            self.leaves.append(leaf)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for features, cuts, leaf in zip(self.features, self.cuts, self.leaves):
            node = np.zeros(len(x), dtype=np.int64)
            for level in range(DEPTH):
                at = 2**level - 1 + node
                node = node * 2 + (x[rows, features[at]] >= cuts[at])
            out += leaf[node]
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit of y on x: knots to interpolate between."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, sum of x
    for xi, yi in zip(x[order], y[order]):
        blocks.append([yi, 1.0, xi])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, w, sx = blocks.pop()
            blocks[-1] = [(blocks[-1][0] * blocks[-1][1] + m * w) / (blocks[-1][1] + w), blocks[-1][1] + w, blocks[-1][2] + sx]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] for b in blocks])


def band_cuts(calibrated: np.ndarray, band: np.ndarray) -> tuple[float, float]:
    """Cuts between the bands that most rows are on the right side of; ties to the one nearest the middle."""
    cuts = []
    for low in (1, 2):
        options = np.arange(low + 0.2, low + 0.81, 0.05)
        right = [((calibrated >= c) == (band > low)).mean() for c in options]
        best = np.flatnonzero(np.array(right) >= max(right) - 1e-9)
        cuts.append(float(options[best[np.abs(options[best] - low - 0.5).argmin()]]))
    return cuts[0], cuts[1]


class GradeModel:
    """Trees, calibration and cuts.

    ``cv_accuracy`` is that of the bands of held-out sources (None if it can't be told), ``cv_sources`` lists (source,
    rows, right) of each: a source's rows were in neither the trees nor the calibration and cuts that grade them.
    """

    def __init__(self, x: np.ndarray, grade: np.ndarray, source: list):
        self.trees = BoostedTrees(x, grade)
        self.knots, self.cuts, self.cv_accuracy, self.cv_sources = (np.array([1.0, 3.0]), np.array([1.0, 3.0])), (1.5, 2.5), None, []
        if len(grade) < 4 * MIN_LEAF:
            return
        names = sorted({str(s) for s in source}, key=lambda s: (-sum(str(z) == s for z in source), s))
        fold_of = {s: i % FOLDS for i, s in enumerate(names)}
        fold = np.array([fold_of[str(s)] for s in source])
        if len(names) == 1:  # a single source cannot be held out
            fold = np.arange(len(grade)) % FOLDS
        held = np.zeros(len(grade))
        for k in np.unique(fold):
            out = fold == k
            held[out] = BoostedTrees(x[~out], grade[~out]).predict(x[out])
        band = np.clip(np.floor(grade + 0.5), 1, 3)
        right = np.zeros(len(grade), dtype=bool)
        for k in np.unique(fold):
            out = fold == k
            if out.all():
                continue
            self.knots = isotonic(held[~out], grade[~out])
            self.cuts = band_cuts(self.calibrate(held[~out]), band[~out])
            right[out] = self.bands(self.calibrate(held[out])) == band[out]
        self.cv_accuracy = float(right.mean())
        labels = np.array([str(s) if s is not None else "" for s in source])
        self.cv_sources = [(str(s) or None, int((labels == s).sum()), int(right[labels == s].sum())) for s in np.unique(labels)]
        self.knots = isotonic(held, grade)
        self.cuts = band_cuts(self.calibrate(held), band)

    def calibrate(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, *self.knots)

    def bands(self, calibrated: np.ndarray) -> np.ndarray:
        return (1 + (calibrated >= self.cuts[0]) + (calibrated >= self.cuts[1])).astype(np.int32)


def measures(docs: DataFrame, prototypes: np.ndarray) -> DataFrame:
    """doc_id, source, measures of documents written wholly in English with MIN_WORDS words or more."""
    shipped = docs.sparkSession.sparkContext.broadcast(prototypes.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, words = languages.Profiles(shipped.value), Words()
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                # words are counted in the text as it is, the measures are taken of its consistent form
                texts = canonical_or_null([t if t and len(t.split()) >= MIN_WORDS else None for t in batch.column(2).to_pylist()])
                english = [i for i, found in enumerate(languages.judge(profiles, texts, by_paragraph=True)) if found and all(f[1] == "en" for f in found)]
                at, values = measure_matrix([texts[i] for i in english], words)
                kept = pa.array(np.array(english, dtype=np.int64)[at])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept), lists], names=["doc_id", "source", "measures"])

    return docs.select("doc_id", "source", "text").mapInArrow(run, "doc_id long, source string, measures array<float>")


def graded(docs: DataFrame, labels: DataFrame, prototypes: np.ndarray) -> tuple[DataFrame, GradeModel]:
    """(doc_id, grade, band) and the model. Labels: doc_id, band; several raters are averaged, null bands left out, unlabelled corpora get the middle band."""
    spark = docs.sparkSession
    own = materialize(measures(docs, prototypes), "measures")
    given = labels.where("band between 1 and 3").groupBy("doc_id").agg(F.avg("band").alias("grade"))
    chosen = own.join(given, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED).collect()
    chosen.sort(key=lambda r: r.doc_id)
    x = np.array([r.measures for r in chosen], dtype=np.float64).reshape(len(chosen), 4 * len(MEASURES))
    model = GradeModel(x, np.array([r.grade for r in chosen]), [r.source for r in chosen])
    shipped = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in batches:
            if batch.num_rows:
                values = np.array(batch.column(1).to_pylist(), dtype=np.float64)
                grade = m.calibrate(m.trees.predict(values))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grade), pa.array(m.bands(grade))], names=["doc_id", "grade", "band"])

    return own.select("doc_id", "measures").mapInArrow(run, "doc_id long, grade double, band int"), model
