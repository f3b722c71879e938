"""Problem 7: token ids of every text by a public byte-level BPE vocabulary.

Method: length-bucketed padded numpy matrices. Texts are cut into pieces by the
vocabulary's pattern; the distinct pieces of a batch that are not known yet are put
into matrices of equal padded length, and in each round every row merges its leftmost
pair of minimum rank, found by a hashed pair lookup, and is compacted.

Scale: one narrow pass without a shuffle; the only shipped state is the vocabulary
file (under 1 MB whatever the corpus). The memory of pieces is bounded and only saves work. Pieces of
more than WIDEST bytes, which as rows would cost the square of their length, go through a heap instead.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the piece pattern of the public vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pieces a worker keeps; beyond it the memory starts anew.
KEPT_PIECES = 400_000
#: Bytes of texts encoded at once.
CHUNK_CHARS = 4_000_000
#: Bytes of the widest matrix row.
WIDEST = 1024
_NONE = np.int64(1) << 40


class Vocabulary:
    """Ranks as arrays: byte ids, and an open-addressed hash of (left, right) to the merged id."""

    def __init__(self, lines: bytes):
        tokens = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines.splitlines() if line.strip())}
        self.byte_ids = np.array([tokens[bytes([b])] for b in range(256)], dtype=np.int32)
        lefts, rights, ids = [], [], []
        for token, rank in tokens.items():
            for cut in range(1, len(token)):
                if (a := tokens.get(token[:cut])) is not None and (b := tokens.get(token[cut:])) is not None:
                    lefts.append(a)
                    rights.append(b)
                    ids.append(rank)
        keys = np.array(lefts, dtype=np.int64) << 32 | np.array(rights, dtype=np.int64)
        self.bits = int(np.ceil(np.log2(len(keys) * 4 + 16)))
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.ids = np.zeros(1 << self.bits, dtype=np.int64)
        self.probes = 0
        left = np.arange(len(keys))
        slot = self._slot(keys)
        values = np.array(ids, dtype=np.int64)
        while len(left):
            self.probes += 1
            free = left[self.keys[slot[left]] == -1]
            self.keys[slot[free]] = keys[free]  # of several wanting one slot the last stays
            self.ids[slot[free]] = values[free]
            placed = self.keys[slot[left]] == keys[left]
            left = left[~placed]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
        won = self._lookup(keys)
        assert (won == values).all()

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _lookup(self, keys: np.ndarray) -> np.ndarray:
        """Merged id of each pair (its rank as well), or a number above all ranks."""
        slot = self._slot(keys)
        out = np.full(keys.shape, _NONE, dtype=np.int64)
        open_ = np.ones(keys.shape, dtype=bool)
        for _ in range(self.probes):
            held = self.keys[slot]
            hit = open_ & (held == keys)
            out[hit] = self.ids[slot[hit]]
            open_ &= ~hit & (held != -1)
            if not open_.any():
                break
            slot = (slot + 1) & ((1 << self.bits) - 1)
        return out

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece."""
        out: list = [None] * len(pieces)
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        width = np.where(lengths <= 16, lengths, 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))
        for i in np.flatnonzero(lengths > WIDEST).tolist():
            out[i] = self._merge_long(pieces[i])
        for w in np.unique(width[lengths <= WIDEST]):
            rows = np.flatnonzero(width == w)
            for at in range(0, len(rows), step := max(1, 2_000_000 // int(w))):
                part = rows[at : at + step]
                raw = np.frombuffer(b"".join(pieces[i].ljust(int(w), b"\0") for i in part), dtype=np.uint8).reshape(len(part), int(w))
                for i, ids in zip(part.tolist(), self._merge_matrix(self.byte_ids[raw].astype(np.int64), lengths[part].copy())):
                    out[i] = ids
        return out

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """Ids of one long piece: the same merges, with the pairs in a heap by rank, then place, and neighbours in linked lists."""
        ids = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)].astype(np.int64)
        n = len(ids)
        ranks = self._lookup(ids[:-1] << 32 | ids[1:])
        heap = [(r, i) for i, r in enumerate(ranks.tolist()) if r < _NONE]
        heapq.heapify(heap)
        token, right, left = ids.tolist(), [*range(1, n), -1], [-1, *range(n - 1)]
        known: dict[tuple[int, int], int] = {}

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0:
                if (pair := (token[i], token[j])) not in known:
                    known[pair] = int(self._lookup(np.array([pair[0] << 32 | pair[1]]))[0])
                if known[pair] < _NONE:
                    heapq.heappush(heap, (known[pair], i))

        alive = bytearray(b"\x01") * n
        pair_rank = dict(enumerate(ranks.tolist()))
        while heap:
            rank, i = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or j < 0 or pair_rank.get(i) != rank:
                continue
            token[i] = rank
            alive[j] = 0
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
            for a, b in ((left[i], i), (i, k)):
                pair_rank.pop(a, None)
                if a >= 0 and b >= 0:
                    offer(a, b)
                    pair_rank[a] = known[token[a], token[b]]
        return np.array([t for t, a in zip(token, alive) if a], dtype=np.int32)

    def _merge_matrix(self, ids: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        done: list = [None] * len(ids)
        row = np.arange(len(ids))
        cols = np.arange(ids.shape[1])
        rank = self._ranks(ids, n)
        while len(row):
            best = rank.argmin(1) if rank.shape[1] else np.zeros(len(row), np.int64)
            at = np.arange(len(row))
            merged = rank[at, best] if rank.shape[1] else np.full(len(row), _NONE)
            over = merged >= _NONE
            if over.any():
                for i in np.flatnonzero(over).tolist():
                    done[row[i]] = ids[i, : n[i]].astype(np.int32)
                stay = ~over
                ids, n, row, rank, best, merged = ids[stay], n[stay], row[stay], rank[stay], best[stay], merged[stay]
                if not len(row):
                    break
                at = np.arange(len(row))
            ids[at, best] = merged
            # compaction: every id right of the merged pair moves one to the left
            source = cols[None, :-1] + (cols[None, :-1] > best[:, None])
            ids = np.take_along_axis(ids, source, 1)
            cols = cols[:-1]
            n -= 1
            moved = rank[:, 1:] if rank.shape[1] > 1 else rank[:, :0]
            kept = np.where(cols[None, :-1] < best[:, None], rank[:, : max(len(cols) - 1, 0)], moved[:, : max(len(cols) - 1, 0)])
            rank = kept
            if rank.shape[1]:
                for side in (best - 1, best):
                    ok = (side >= 0) & (side < n - 1)
                    k, s = np.flatnonzero(ok), side[ok]
                    rank[k, s] = self._lookup(ids[k, s] << 32 | ids[k, s + 1])
                rank[cols[None, :-1] >= (n - 1)[:, None]] = _NONE
        return done

    def _ranks(self, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        if ids.shape[1] < 2:
            return np.zeros((len(ids), 0), dtype=np.int64)
        rank = self._lookup(ids[:, :-1] << 32 | ids[:, 1:])
        rank[np.arange(ids.shape[1] - 1)[None, :] >= (n - 1)[:, None]] = _NONE
        return rank


class _Numbers(dict):
    """Gives each new piece the next number."""

    def __missing__(self, piece):
        self[piece] = n = len(self)
        return n


class Encoder:
    def __init__(self, lines: bytes):
        self.vocabulary = Vocabulary(lines)
        self.pieces = regex.compile(PATTERN).findall
        self._reset()

    def _reset(self) -> None:
        self.numbers, self.known = _Numbers(), 0
        self.flat, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def piece_numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of every piece, and how many pieces each text has; unseen pieces are merged."""
        if self.known > KEPT_PIECES:
            self._reset()
        number = self.numbers.__getitem__
        found = [list(map(number, self.pieces(t))) for t in texts]
        counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        flat = np.fromiter((x for f in found for x in f), dtype=np.int64, count=int(counts.sum()))
        if len(self.numbers) > self.known:
            fresh = [p.encode("utf-8", "surrogatepass") for p in list(self.numbers)[self.known :]]
            ids = self.vocabulary.merge(fresh)
            sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            starts = len(self.flat) + np.r_[0, np.cumsum(sizes)[:-1]]
            self.flat = np.concatenate([self.flat, *ids])
            self.starts, self.sizes = np.r_[self.starts, starts], np.r_[self.sizes, sizes]
            self.known = len(self.numbers)
        return flat, counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text."""
        pieces, counts = self.piece_numbers(texts)
        sizes = self.sizes[pieces]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[pieces] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
        per = np.diff(np.r_[0, ends][np.r_[0, np.cumsum(counts)]])
        return self.flat[at], per

    def lengths(self, texts: list[str]) -> np.ndarray:
        pieces, counts = self.piece_numbers(texts)
        return np.diff(np.r_[0, np.cumsum(self.sizes[pieces])][np.r_[0, np.cumsum(counts)]])


@functools.lru_cache(maxsize=2)
def _encoder(lines: bytes) -> Encoder:
    return Encoder(lines)


def _chunks(texts: list, chars: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= chars:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def vocabulary_lines(folder: str = TOKENIZERS, name: str = VOCABULARY) -> bytes:
    with open(f"{folder}/{name}", "rb") as f:
        return f.read()


def _shipped(spark: SparkSession, folder: str):
    return spark.sparkContext.broadcast(vocabulary_lines(folder))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """``id_col`` and ``ids``; a null or empty text gives an empty list, special-token strings are ordinary text."""
    lines = _shipped(docs.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(lines.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _chunks(texts):
                ids, per = encoder.encode(texts[a:b])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per)].astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def with_token_counts(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, folder: str = TOKENIZERS) -> DataFrame:
    """The kept columns and ``n_tokens`` (0 for null and empty texts)."""
    lines = _shipped(docs.sparkSession, folder)
    keep = keep or [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(lines.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            sizes = [encoder.lengths(texts[a:b]) for a, b in _chunks(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(sizes).astype(np.int64) if sizes else np.zeros(0, np.int64))], names=[*keep, "n_tokens"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, text_col).mapInArrow(run, f"{schema}, n_tokens long")
