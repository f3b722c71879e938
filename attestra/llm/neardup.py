"""Problem 5: near-duplicate records with small edits.

Method: HyperMinHash. A hash of a word picks one of a few buckets by its first bits; the
bucket keeps, of the smallest of the hashes that fall in it, the leading-zero count and the
mantissa bits that follow, packed in 16 bits; smaller hashes have smaller codes, so the register of
a set is the minimum of its words' codes. Quotes are some twenty words long, so one hash could
fill but a handful of buckets: the sketch is made of HASHES hashes of BUCKETS buckets each, and an
empty bucket borrows from the next one of the same hash, marked by the distance. Bands of registers
give candidate pairs, an estimate of the Jaccard similarity from the first registers, corrected for
chance collisions, drops unlike pairs, and the word sets of what is left are compared exactly.

Scale: copies (equal word sets) become one class before banding, so no group of
copies is ever paired with itself; a band row costs 6 bytes (32-bit key and 16-bit
offset, packed in blobs that are never empty, so their number is bounded by the band rows);
every stage is written to the shared folder and partition counts follow the number of classes.
Nothing is capped: a band key shared by many classes is cut in blocks that are paired by
different tasks.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm import pairs
from attestra.llm.canon import canonical, is_placeholder
from attestra.tables import discard, materialize

WORD = re.compile(r"[^\W_]+")
#: kana and unified ideographs
KANA_KANJI = re.compile("[぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff]")
#: Registers are bands * rows; a pair of similarity s shares a band with 1-(1-s^rows)^bands:
#: 0.981 at 0.70, 0.9995 at 0.75, 0.999999 at 0.80.
BANDS, ROWS = 96, 9
#: Registers are HASHES * BUCKETS; one bucket of each hash comes before the next, so the rows of a band are of different hashes.
BUCKETS = 4
HASHES = BANDS * ROWS // BUCKETS
#: Registers (of different hashes) that the estimate reads, 4 bits of each, and how often those agree by chance.
SKETCH, CHANCE = 64, 1 / 16
EMPTY = 0xFFFF
#: Classes under one band key that a task pairs at once.
HOT_RUN = 4096
#: Words whose register codes are held at once (about 100 MB).
MAX_VOCABULARY = 60_000
KEPT_WORDS = 200_000
#: Classes banded at once (offsets have 16 bits).
BAND_ROWS = 20_000
KEYS_PER_PARTITION = 1_500_000
PAIR_COLUMNS = ["a", "b", "left", "right"]


def words_of(text: str) -> list[str]:
    """Distinct words: lower-case runs of letters and digits; pairs of characters where a run holds kana or kanji."""
    out: dict[str, None] = dict.fromkeys(WORD.findall(text.lower()))
    if not text.isascii() and KANA_KANJI.search(text):
        for w in [w for w in out if len(w) > 1 and KANA_KANJI.search(w)]:
            del out[w]
            out.update(dict.fromkeys(w[i : i + 2] for i in range(len(w) - 1)))
    return list(out)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt)) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(29))


def register_codes(hashes: np.ndarray, functions: int) -> np.ndarray:
    """Code of each word in its bucket of each hash (EMPTY in the others): 15 minus the leading zeros (4 bits), then 12 mantissa bits."""
    out = np.full((len(hashes), BUCKETS, functions), EMPTY, dtype=np.uint16)
    rows = np.arange(len(hashes))
    for g in range(functions):
        mixed = _mix(hashes, (g + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        bucket = (mixed >> np.uint64(62)).astype(np.int64)
        x = (mixed & np.uint64((1 << 62) - 1)) >> np.uint64(10)  # 52 bits, exact in a double
        mantissa, exponent = np.frexp(x.astype(np.float64))
        zeros = np.minimum(52 - exponent, 15)
        out[rows, bucket, g] = ((15 - zeros) << 12) | np.where(zeros < 15, ((mantissa * 2 - 1) * 4096).astype(np.int64), np.minimum(x >> np.uint64(26), np.uint64(4095)).astype(np.int64))
    return out.reshape(len(hashes), BUCKETS * functions)


def fill_empty(registers: np.ndarray) -> np.ndarray:
    """Empty buckets take the code of the next filled one of their hash, marked by how far it is."""
    shaped = registers.reshape(len(registers), BUCKETS, -1)
    held = shaped.copy()
    for distance in range(1, BUCKETS):
        for b in range(BUCKETS):
            source = held[:, (b + distance) % BUCKETS]
            open_ = (shaped[:, b] == EMPTY) & (source != EMPTY)
            np.copyto(shaped[:, b], source ^ np.uint16(distance * 0x1555), where=open_)
    return registers


def small_codes(registers: np.ndarray) -> np.ndarray:
    """The last 4 mantissa bits of each register, two to a byte: unequal registers agree in them once in 16."""
    low = (registers & 15).astype(np.uint8)
    return low[:, 0::2] | low[:, 1::2] << 4


def similarity(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of agreeing small codes, corrected for chance collisions."""
    differ = left ^ right
    agree = ((differ & 15) == 0).mean(1) / 2 + ((differ >> 4) == 0).mean(1) / 2
    return (agree - CHANCE) / (1 - CHANCE)


class _Hashes(dict):
    """Remembers the 64-bit hash of each word; only saves work."""

    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to word-hash sets; the set goes out only with the first text of its class in this task's batch."""
    vocabulary = _Hashes()
    for batch in batches:
        if len(vocabulary) > KEPT_WORDS:
            vocabulary.clear()
        keys = batch.column(0)
        kept, d1, d2, sets, seen = [], [], [], [], set()
        for i, text in enumerate(batch.column(1).to_pylist()):
            ws = words_of(text)
            if not ws:
                continue
            own = np.fromiter(map(vocabulary.__getitem__, ws), dtype=np.uint64, count=len(ws))
            own.sort()
            a, b = xxhash.xxh3_64_intdigest(raw := own.tobytes()), xxhash.xxh64_intdigest(raw, seed=7)
            kept.append(i)
            d1.append(a)
            d2.append(b)
            sets.append(None if (a, b) in seen else own.view(np.int64))
            seen.add((a, b))
        yield pa.RecordBatch.from_arrays(
            [
                keys.take(pa.array(kept, pa.int64())),
                pa.array(np.array(d1, dtype=np.uint64).view(np.int64)),
                pa.array(np.array(d2, dtype=np.uint64).view(np.int64)),
                pa.array(sets, pa.list_(pa.int64())),
            ],
            names=["text_key", "d1", "d2", "words"],
        )


def _register_matrix(words: pa.ListArray, functions: int = HASHES) -> np.ndarray:
    """16-bit registers of each set; the table of the words' codes is kept under MAX_VOCABULARY rows."""
    flat = words.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    ends = np.cumsum(np.diff(words.offsets.to_numpy()))
    out = np.full((len(ends), BUCKETS * functions), EMPTY, dtype=np.uint16)
    todo = [(0, len(flat))]
    while todo:
        lo, hi = todo.pop()
        vocabulary, at = np.unique(flat[lo:hi], return_inverse=True)
        if len(vocabulary) > MAX_VOCABULARY:  # many different words, or one very long text: halves, cut anywhere
            todo += [(lo, (lo + hi) // 2), ((lo + hi) // 2, hi)]
            continue
        codes = register_codes(vocabulary, functions)
        first = int(np.searchsorted(ends, lo, side="right"))
        a = lo
        while a < hi:
            b = min(int(ends[first]), hi)
            np.minimum(out[first], np.minimum.reduce(codes[at[a - lo : b - lo]], axis=0), out=out[first])
            a, first = b, first + 1
    return fill_empty(out)


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have ``rows`` rows, so that they share a table of codes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _consecutive(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of consecutive ids (a batch may hold the rows of several files)."""
    ids = batch.column(0).to_numpy()
    starts = np.r_[0, np.flatnonzero(np.diff(ids) != 1) + 1, len(ids)].tolist()
    for a, b in zip(starts, starts[1:]):
        for at in range(a, b, most):
            yield batch.slice(at, min(most, b - at))


def _band_blobs(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _gathered(batches, BAND_ROWS):
            for batch in _consecutive(whole, BAND_ROWS):
                ids = batch.column(0).to_numpy()
                registers = _register_matrix(batch.column(1))
                keys = np.zeros((len(ids), BANDS), dtype=np.uint64)
                banded = registers.reshape(len(ids), BANDS, ROWS)
                for r in range(ROWS):
                    keys = _mix(keys * np.uint64(0x100000001B3) + banded[:, :, r], 0x2545F4914F6CDD1D)
                keys = _mix(keys + np.arange(BANDS, dtype=np.uint64), 0x27D4EB2F165667C5)
                part = (keys % np.uint64(parts)).astype(np.int32).ravel()
                low = (keys >> np.uint64(32)).astype(np.uint32).ravel()
                offset = np.repeat(np.arange(len(ids), dtype=np.uint16), BANDS)
                order = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[order], np.arange(parts + 1))
                low, offset = low[order], offset[order]
                filled = np.flatnonzero(np.diff(cuts))
                blobs = [low[a:b].tobytes() + offset[a:b].tobytes() for a, b in zip(cuts[filled].tolist(), cuts[filled + 1].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(filled.astype(np.int32)), pa.array(np.full(len(filled), ids[0])), pa.array(blobs, pa.binary())], names=["part", "base", "blob"])

    return run


def _equal_key_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of classes with equal band keys in one partition, in chunks; runs beyond HOT_RUN go out as pairs of blocks (left, right)."""
    keys, ids = [], []
    for batch in batches:
        for base, blob in zip(batch.column("base").to_pylist(), batch.column("blob").to_pylist()):
            n = len(blob) // 6
            keys.append(np.frombuffer(blob, dtype=np.uint32, count=n))
            ids.append(np.frombuffer(blob, dtype=np.uint16, count=n, offset=4 * n).astype(np.int64) + base)
    if not sum(map(len, keys)):
        return
    key, cls = np.concatenate(keys), np.concatenate(ids)
    order = np.argsort(key, kind="stable")
    key, cls = key[order], cls[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    for s, n in zip(starts[sizes > HOT_RUN].tolist(), sizes[sizes > HOT_RUN].tolist()):
        blocks = [cls[a : min(a + HOT_RUN, s + n)] for a in range(s, s + n, HOT_RUN)]
        for i, left in enumerate(blocks):
            for right in blocks[i:]:
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([left], pa.list_(pa.int64())), pa.array([right], pa.list_(pa.int64()))], names=PAIR_COLUMNS)
    starts, sizes = starts[sizes <= HOT_RUN], sizes[sizes <= HOT_RUN]
    a_out, b_out, held = [], [], 0

    def flush() -> pa.RecordBatch:
        a, b = np.concatenate(a_out), np.concatenate(b_out)
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b], axis=0)
        a_out.clear()
        b_out.clear()
        blocks = pa.nulls(len(both), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), blocks, blocks], names=PAIR_COLUMNS)

    for gap in range(1, int(sizes.max(initial=0))):  # the member `gap` places further in the same run
        starts, sizes = starts[sizes > gap], sizes[sizes > gap]
        reps = sizes - gap
        for at in range(0, len(starts), 1 << 20):
            s, n = starts[at : at + (1 << 20)], reps[at : at + (1 << 20)]
            pos = np.repeat(s - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum()))
            a_out.append(cls[pos])
            b_out.append(cls[pos + gap])
            held += len(pos)
            if held > 2_000_000:
                held = 0
                yield flush()
    if a_out:
        yield flush()


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs of a class of the left and one of the right block, each unordered pair of different classes once."""
    for batch in batches:
        for left, right in zip(batch.column(0), batch.column(1)):
            x, y = (c.values.to_numpy() for c in (left, right))
            for at in range(0, len(x), 256):
                a, b = np.repeat(x[at : at + 256], len(y)), np.tile(y, len(x[at : at + 256]))
                both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b], axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first SKETCH registers of each class, which are banded as well, cut to 4 bits."""
    for batch in batches:
        sketch = small_codes(_register_matrix(batch.column(1), SKETCH)[:, :SKETCH])
        sizes = np.diff(batch.column(1).offsets.to_numpy()).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array([x.tobytes() for x in sketch], pa.binary())], names=["id", "n", "sketch"])


def _likely(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, m = batch.column(2).to_numpy().astype(float), batch.column(4).to_numpy().astype(float)
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH // 2) for c in (3, 5))
            estimate = similarity(left, right)
            equal = CHANCE + (1 - CHANCE) * threshold
            slack = 4 * np.sqrt(equal * (1 - equal) / SKETCH) / (1 - CHANCE)  # four standard deviations
            ok = (estimate >= threshold - slack) & (np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))], names=["a", "b"])

    return run


class NearDuplicates:
    """Classes of equal word sets, their links of Jaccard ``threshold`` or more, and who belongs to them.

    ``texts`` has ``text_key`` (unique long) and ``text``. Null texts, placeholders and texts without a
    word belong to no class. ``members``: text_key, d1, d2. ``links``: a1, a2, b1, b2 (the
    fingerprints of both classes) and jaccard, each unordered pair once. Links between
    different classes are found with the probability stated at ``BANDS``; equal sets always meet.
    """

    def __init__(self, texts: DataFrame, threshold: float = 0.7):
        spark = texts.sparkSession
        wanted = texts.where(~is_placeholder(F.col("text"))).select("text_key", canonical(F.col("text")).alias("text"))
        sets = materialize(wanted.mapInArrow(_sets, "text_key long, d1 long, d2 long, words array<long>"), "wordsets")
        self.members = materialize(sets.select("text_key", "d1", "d2"), "members")
        one = sets.where("words is not null").groupBy("d1", "d2").agg(F.first("words").alias("words"))
        classes = materialize(one.select(F.monotonically_increasing_id().alias("id"), "d1", "d2", "words"), "classes")
        discard(sets)
        self._release(spark)
        total = classes.count()
        parts = max(1, -(-total * BANDS // KEYS_PER_PARTITION))
        blobs = classes.select("id", "words").mapInArrow(_band_blobs(parts), "part int, base long, blob binary")
        # one part is one partition: no second shuffle, no sort, and no two parts in a task
        met = blobs.repartitionById(parts, F.col("part")).mapInArrow(_equal_key_pairs, "a long, b long, left array<long>, right array<long>")
        met = materialize(met, "met")
        self._release(spark)
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        hot = met.where("left is not null").select("left", "right").repartition(tasks).mapInArrow(_block_pairs, "a long, b long")
        # placed by a, where the sketches of a come next: once through the network for both
        candidates = met.where("left is null").select("a", "b").union(hot).repartition("a").dropDuplicates(["a", "b"])
        sketch = classes.select("id", "words").mapInArrow(_sketches, "id long, n int, sketch binary")
        sketch = materialize(sketch, "sketches")
        left = sketch.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
        right = sketch.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
        likely = candidates.join(left, "a").join(right, "b").select("a", "b", "na", "sa", "nb", "sb").mapInArrow(_likely(threshold), "a long, b long")
        likely = materialize(likely, "likely")
        discard(met, sketch)
        self._release(spark)
        involved = likely.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        involved = classes.join(involved, "id", "left_semi")
        left = involved.select(F.col("id").alias("a"), F.col("d1").alias("a1"), F.col("d2").alias("a2"), F.col("words").alias("wa"))
        right = involved.select(F.col("id").alias("b"), F.col("d1").alias("b1"), F.col("d2").alias("b2"), F.col("words").alias("wb"))
        both = F.size(F.array_intersect("wa", "wb"))
        exact = both / (F.size("wa") + F.size("wb") - both)
        self.links = materialize(
            likely.join(left, "a").join(right, "b").withColumn("jaccard", exact).where(F.col("jaccard") >= threshold).select("a1", "a2", "b1", "b2", "jaccard"),
            "links",
        )
        discard(likely, classes)
        self._release(spark)

    @staticmethod
    def _release(spark) -> None:
        """Let go of the shuffle files of finished stages."""
        gc.collect()
        spark.sparkContext._jvm.System.gc()

    def row_pairs(self, row_of: Column) -> DataFrame:
        """record_a < record_b of all linked rows, copies included, each pair once; ``row_of`` maps text_key to the row's id."""
        m = self.members.select(row_of.alias("id"), "d1", "d2")
        counted = materialize(pairs.sizes(m, ["d1", "d2"]), "sizes")
        same = pairs.within(m, counted, ["d1", "d2"])
        cross = pairs.between(self.links, m, counted, ["a1", "a2"], ["b1", "b2"], ["d1", "d2"])
        return same.union(cross).distinct()

    def rows(self, row_of: Column) -> DataFrame:
        """One row per text: row, text_key, class_id (fingerprint in hex), copies in the class and links to other classes."""
        per = self.links.select("a1", "a2").union(self.links.select("b1", "b2")).toDF("d1", "d2").groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("links"))
        sizes = self.members.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("copies"))
        info = sizes.join(per, ["d1", "d2"], "left")
        return self.members.join(info, ["d1", "d2"]).select(row_of.alias("record_id"), "text_key", F.concat(F.lower(F.hex("d1")), F.lower(F.hex("d2"))).alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))


def text_rows(table: DataFrame, id_col: str, text_cols: list[str]) -> DataFrame:
    """One row per text column: text_key = id * number of columns + position."""
    k = len(text_cols)
    return table.select(F.explode(F.array(*[F.struct((F.col(id_col) * k + i).alias("text_key"), F.col(c).alias("text")) for i, c in enumerate(text_cols)])).alias("t")).select("t.*")


def row_of_text(k: int) -> Column:
    return F.expr(f"text_key div {k}").cast("long")
