"""Scoring pairs of texts on the same page: native stages first, Python only for what they leave open."""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.functions.scalars import normalize_text
from attestra.tables import materialize

# Shortest normalized text, least common run of tokens (short and other texts) and of characters.
MIN_NORMALIZED, MIN_TOKENS, SHORT_SIDE, RUN_SHORT, RUN, RUN_CHARS = 12, 4, 6, 4, 6, 20


#: Cells of a batch of tables held at once, and cells of one pair beyond which windows are hashed instead.
CELLS, WIDE = 1 << 21, 1 << 22


def longest_runs(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Length of the longest block that the two sequences of each pair share.

    Pairs of like lengths are one padded batch: a table row per item of the shorter side, all pairs at once.
    """
    out = np.zeros(len(pairs), dtype=np.int64)
    sizes = np.array([(min(len(a), len(b)), max(len(a), len(b))) for a, b in pairs], dtype=np.int64).reshape(-1, 2)
    wide = sizes[:, 0] * sizes[:, 1] > WIDE
    for i in np.flatnonzero(wide).tolist():
        out[i] = _run_by_windows(*pairs[i])
    short = np.flatnonzero(~wide & (sizes[:, 0] > 0))
    order = short[np.lexsort((sizes[short, 1], np.ceil(np.log2(sizes[short, 0]))))]
    at = 0
    while at < len(order):
        m, end = 0, at
        while end < len(order) and (end == at or (end - at + 1) * max(m, sizes[order[end], 1]) <= CELLS):
            m, end = max(m, sizes[order[end], 1]), end + 1
        part = order[at:end]
        n, m = int(sizes[part, 0].max()), int(sizes[part, 1].max())
        rows, columns = np.full((n, len(part)), -1, dtype=np.int64), np.full((len(part), m), -2, dtype=np.int64)
        for k, p in enumerate(part.tolist()):
            a, b = pairs[p] if len(pairs[p][0]) <= len(pairs[p][1]) else pairs[p][::-1]
            rows[: len(a), k], columns[k, : len(b)] = a, b
        run = np.zeros((len(part), m + 1), dtype=np.int32)
        best = np.zeros(len(part), dtype=np.int32)
        for row in rows:
            run[:, 1:] = (run[:, :-1] + 1) * (columns == row[:, None])
            np.maximum(best, run.max(1), out=best)
        out[part] = best
        at += len(part)
    return out


def _run_by_windows(a: np.ndarray, b: np.ndarray) -> int:
    """The same for long sequences: the greatest size at which both have an equal window, by bisection over window hashes."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        k = (low + high + 1) // 2
        x, y = (_windows(c, k) for c in (a, b))
        if np.isin(x, y).any():
            low = k
        else:
            high = k - 1
    return low


def may_share(a: list[str] | str, b: list[str] | str, run: int) -> bool:
    """False only if no run of ``run`` items is common: any such run holds a whole aligned block of half its length."""
    block = max(1, run // 2)
    if isinstance(a, str):
        return any(a[i : i + block] in b for i in range(0, len(a) - block + 1, block))
    text = f" {' '.join(b)} "
    return any(f" {' '.join(a[i : i + block])} " in text for i in range(0, len(a) - block + 1, block))


def fuzzy_scores(quotes: list[str | None], texts: list[str | None], threshold: float = 0.0) -> tuple[np.ndarray, list[str]]:
    """Coverage of the shorter side by the longest common run of tokens or, if that is better, of characters, and which; 0 and none for nulls.

    Scores below ``threshold`` may be given as 0: runs that cannot reach it are not searched.
    """
    score, method = np.zeros(len(quotes)), ["none"] * len(quotes)
    for stage in ("fuzzy_token", "fuzzy_character"):
        at, pairs, least = [], [], []
        for i, (q, p) in enumerate(zip(quotes, texts)):
            if q is None or p is None:
                continue
            a, b = (q.split(), p.split()) if stage == "fuzzy_token" else (q.replace(" ", ""), p.replace(" ", ""))
            if len(a) > len(b):
                a, b = b, a
            if stage == "fuzzy_token":
                floor, enough = (RUN_SHORT if len(a) <= SHORT_SIDE else RUN), len(a) >= MIN_TOKENS
            else:
                floor, enough = RUN_CHARS, len(a) >= RUN_CHARS
            floor = max(floor, math.ceil(max(threshold, score[i]) * len(a) - 1e-9))
            if enough and may_share(a, b, floor):
                numbers: dict = {}
                code = lambda x: np.array([numbers.setdefault(t, len(numbers)) for t in x], dtype=np.int64) if isinstance(x, list) else np.frombuffer(x.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
                at.append(i)
                pairs.append((code(a), code(b)))
                least.append(floor)
        for i, (a, _), floor, run in zip(at, pairs, least, longest_runs(pairs).tolist()):
            if run >= floor and run / len(a) > score[i]:
                score[i], method[i] = run / len(a), stage
    return score, method


def fuzzy(q: str, p: str, threshold: float = 0.0) -> tuple[float, str]:
    """One pair of :func:`fuzzy_scores`."""
    score, method = fuzzy_scores([q], [p], threshold)
    return float(score[0]), method[0]


def _fuzzy_udf(threshold: float):
    @F.pandas_udf(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("method", T.StringType())]))
    def run(q: pd.Series, p: pd.Series) -> pd.DataFrame:
        score, method = fuzzy_scores([x if isinstance(x, str) else None for x in q], [x if isinstance(x, str) else None for x in p], threshold)
        return pd.DataFrame({"score": score, "method": method})

    return run


def score_pairs(pairs: DataFrame, quote: str, text: str, fuzzy_stage: bool = True, null_as_literal: bool = False, threshold: float = 0.0) -> DataFrame:
    """Adds score and method (raw_equal, raw_contains, normalized_equal, normalized_contains, normalized_container, fuzzy_token, fuzzy_character, none).

    A null or blank side scores 0; with ``null_as_literal`` a null is read as the word None,
    which lets missing texts match each other. Scores below ``threshold`` may come out as 0.
    """
    fill = lambda c: F.trim(F.coalesce(F.col(c), F.lit("None")) if null_as_literal else F.col(c))
    d = pairs.withColumns({"_q": fill(quote), "_p": fill(text)})
    d = d.withColumns({"_qn": normalize_text("_q"), "_pn": normalize_text("_p")})
    given = F.coalesce((F.col("_q") != "") & (F.col("_p") != ""), F.lit(False))
    long_enough = F.least(F.char_length("_qn"), F.char_length("_pn")) >= MIN_NORMALIZED
    native = (
        F.when(~given, "none").when(F.col("_q") == F.col("_p"), "raw_equal").when(F.contains(F.col("_p"), F.col("_q")), "raw_contains")
        .when(~long_enough, "none").when(F.col("_qn") == F.col("_pn"), "normalized_equal").when(F.contains(F.col("_pn"), F.col("_qn")), "normalized_contains")
        .when(F.contains(F.col("_qn"), F.col("_pn")), "normalized_container")
    )
    d = d.withColumn("_m", native if fuzzy_stage else F.coalesce(native, F.lit("none")))
    score = F.when(F.col("_m").isNotNull(), F.when(F.col("_m") == "none", 0.0).otherwise(1.0))
    if not fuzzy_stage:
        return d.withColumns({"score": score, "method": F.col("_m")}).drop("_q", "_p", "_qn", "_pn", "_m")
    open_ = F.col("_m").isNull()
    d = d.withColumn("_f", _fuzzy_udf(threshold)(F.when(open_, F.col("_qn")), F.when(open_, F.col("_pn"))))
    return d.withColumns({"score": F.coalesce(score, F.col("_f.score")), "method": F.coalesce("_m", F.col("_f.method"))}).drop("_q", "_p", "_qn", "_pn", "_m", "_f")


#: Smallest windows of characters and tokens; runs that count are longer than texts too short for them.
MIN_WINDOW, MIN_TOKEN_WINDOW = 4, 2
_BASE, _INVERSE = np.uint64(0x100000001B3), np.uint64(pow(0x100000001B3, -1, 1 << 64))


@functools.lru_cache(maxsize=4)
def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    steps = np.arange(n, dtype=np.uint64)
    return _BASE**steps, _INVERSE**steps  # wrap around, as hashes may


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    power, back = _power_tables(max(4096, 1 << (n - 1).bit_length()))
    return power[:n], back[:n]


def spread(df: DataFrame) -> DataFrame:
    """As many partitions as shuffles have: small rows that cost much Python time must not be coalesced into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _windows(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every window of k items; equal windows get equal values wherever they stand."""
    power, back = _powers(len(codes))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(0x9E3779B9)) * power)])
    h = (sums[k:] - sums[:-k]) * back[: len(codes) - k + 1]
    return (h * np.uint64(0xFF51AFD7ED558CCD)) ^ (h >> np.uint64(29))


def winnowed(codes: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of the windows of k items that are smallest among k neighbours.

    Two sequences that share a run of 2k-1 items share one of them.
    """
    if len(codes) < k:
        return np.zeros(0, np.uint64)
    h = _windows(codes, k)
    if len(h) <= k:
        return h.min(keepdims=True)
    return np.unique(np.lib.stride_tricks.sliding_window_view(h, k).min(1))


def window_for(run: int, smallest: int) -> int:
    """Greatest power of two k with 2k-1 <= run; 0 if that is under ``smallest``."""
    k = 1 << max(0, ((run + 1) // 2).bit_length() - 1)
    return k if k >= smallest else 0


def _window_size(run: Column) -> Column:
    """Greatest power of two k with 2k-1 <= run."""
    return F.pow(F.lit(2), F.length(F.bin(((run + 1) / 2).cast("long"))) - 1).cast("int")


def own_windows(normalized: Column, threshold: float) -> Column:
    """Window sizes of a text as the shorter side: characters without blanks (positive) and tokens (negative)."""
    size = _window_size
    least = lambda n: F.ceil(F.lit(threshold) * n - 1e-9).cast("long")
    bare, tokens = F.char_length(F.replace(normalized, F.lit(" "), F.lit(""))), F.size(F.split(normalized, " "))
    chars = size(least(bare))
    words = size(F.greatest(F.when(tokens <= SHORT_SIDE, RUN_SHORT).otherwise(RUN), least(tokens)))
    return F.array_compact(F.array(F.when(chars >= MIN_WINDOW, chars), F.when((tokens >= MIN_TOKENS) & (words >= MIN_TOKEN_WINDOW), -words)))


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Last columns: whether blanks count, own sizes, the sizes in use on the page, text; out: size, whether it is an own one, fingerprint."""
    for batch in batches:
        at, sizes, roles, prints = [], [], [], []
        columns = [batch.column(batch.num_columns - c).to_pylist() for c in (4, 3, 2, 1)]
        for i, (blanks, own, used, text) in enumerate(zip(*columns)):
            tokens = text.split(" ")
            chars = np.frombuffer((text if blanks else "".join(tokens)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            codes = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in tokens], dtype=np.uint32) if any(k < 0 for k in used) else chars
            for k in used:
                marks = winnowed(chars if k > 0 else codes, abs(k))
                at += [i] * len(marks)
                sizes += [k] * len(marks)
                roles += [k in own] * len(marks)
                prints.append(marks)
        rows = batch.take(pa.array(at, pa.int64()))
        flat = np.concatenate(prints) if prints else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([*rows.columns[:-4], pa.array(sizes, pa.int32()), pa.array(roles, pa.bool_()), pa.array(flat.view(np.int64))], names=[*batch.schema.names[:-4], "k", "own", "mark"])


#: Characters of a short text's beginning by which containment is looked for.
HEAD = 12


def contained(left: DataFrame, right: DataFrame, page: list[str], key: str, value: str) -> DataFrame:
    """page columns, l, r: hashes ``key`` of the texts of a page of which ``value`` of the left is part of that of the right.

    For short texts on the left: the beginning of a text (HEAD characters, all of a shorter one) is met by the pieces
    of that length of the other texts of its page, in the JVM, and the whole text is compared then. Only
    pages with such texts are looked at, and none is paired with itself. Empty texts are part of nothing.
    """
    size = F.least(F.char_length(value), F.lit(HEAD))
    heads = left.where(F.col(value) != "").select(*page, F.col(key).alias("l"), F.col(value).alias("a"), size.alias("k"), F.xxhash64(F.substring(value, 1, HEAD)).alias("mark"))
    used = heads.groupBy(*page).agg(F.collect_set("k").alias("ks"))  # at most HEAD lengths
    pieces = F.expr(f"explode(array_distinct(flatten(transform(ks, k -> transform(sequence(1, greatest(char_length({value}) - k + 1, 1)), i -> struct(k as k, xxhash64(substring({value}, i, k)) as mark))))))")
    marks = right.where(F.col(value) != "").join(used, page).select(*page, F.col(key).alias("r"), F.col(value).alias("b"), pieces.alias("p")).select(*page, "r", "b", "p.*")
    return heads.join(marks, [*page, "k", "mark"]).where(F.contains(F.col("b"), F.col("a"))).select(*page, "l", "r")


def page_candidates(left: DataFrame, right: DataFrame, page: list[str], threshold: float, raw_only: bool = False) -> DataFrame:
    """page columns, q, t: distinct texts of a page that can reach the threshold, without pairing the whole page.

    ``left``: page columns and q, ``right``: page columns and t, distinct and not null. A score of ``threshold``
    or more needs a common run of that share of the shorter normalized text, in characters without blanks
    or in tokens, so both share a winnowed window of the shorter one's size; windows meet by an equi-join on
    page, size and fingerprint. Texts too short for windows (some ten characters) can only be a part of another
    (or have another as part), which :func:`contained` finds. ``raw_only``: the windows are of the texts as they are.
    """
    trimmed = lambda df, c: df.withColumns({"h": F.xxhash64(c), "raw": F.trim(c)})
    if raw_only:
        form = lambda df, c: trimmed(df, c).withColumn("n", F.col("raw")).withColumns({"bare": F.char_length("n"), "own": F.array_compact(F.array(F.when(F.char_length("n") >= 2 * MIN_WINDOW - 1, _window_size(F.char_length("n")))))})
        tiny = 2 * MIN_WINDOW - 2
    else:
        # normalized once, over all tasks: the table serves the sizes, the windows and the texts
        form = lambda df, c: materialize(spread(trimmed(df, c)).withColumn("n", normalize_text(c)), "texts").withColumns({"own": own_windows(F.col("n"), threshold), "bare": F.char_length(F.replace("n", F.lit(" "), F.lit("")))})
        tiny = math.ceil((2 * MIN_WINDOW - 1) / threshold)
    l, r = form(left, "q"), form(right, "t")
    sizes = l.select(*page, F.explode("own").alias("k")).union(r.select(*page, F.explode("own").alias("k")))
    used = sizes.groupBy(*page).agg(F.collect_set("k").alias("used"))  # powers of two: a few per page
    kinds = ", ".join(f"`{c}` {left.schema[c].dataType.simpleString()}" for c in page)
    schema = f"{kinds}, h long, k int, own boolean, mark long"
    made = lambda df: spread(df.join(used, page).select(*page, "h", F.lit(raw_only).alias("blanks"), "own", "used", "n")).mapInArrow(_seeds, schema)
    ls, rs = made(l).withColumnsRenamed({"h": "l", "own": "lo"}), made(r).withColumnsRenamed({"h": "r", "own": "ro"})
    met = ls.join(rs, [*page, "k", "mark"]).where("lo or ro").select(*page, "l", "r")
    small = lambda df: df.where(F.col("bare") <= tiny)
    met = met.union(contained(small(l), r, page, "h", "raw"))
    if not raw_only:
        met = met.union(contained(small(l), r, page, "h", "n")).union(contained(small(r), l, page, "h", "n").select(*page, F.col("r").alias("l"), F.col("l").alias("r")))
    lt, rt = l.select(*page, "q", F.col("h").alias("l")), r.select(*page, "t", F.col("h").alias("r"))
    return met.distinct().join(lt, [*page, "l"]).join(rt, [*page, "r"]).select(*page, "q", "t")


def best_field(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Best score of several field pairs of the same two rows; the lower ``field_order`` wins ties."""
    best = F.max_by(F.struct("score", "method", "field_order"), F.struct("score", -F.col("field_order")))
    return scored.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def edges(left: DataFrame, right: DataFrame, page: list[str], left_id: str, right_id: str, left_fields: list[str], right_fields: list[str], threshold: float, fuzzy_stage: bool = True, null_as_literal: bool = False, only: list[str] | None = None) -> DataFrame:
    """page columns, l, r, score, method of pairs on the same page whose best field pair reaches the threshold.

    ``only`` keeps some methods. The page is an equi-join key; scores are computed once per distinct pair of texts on a page.
    """
    l = left.select(*page, F.col(left_id).alias("l"), F.posexplode(F.array(*left_fields)).alias("lf", "q"))
    r = right.select(*page, F.col(right_id).alias("r"), F.posexplode(F.array(*right_fields)).alias("rf", "t"))
    lu, ru = l.select(*page, "q").distinct(), r.select(*page, "t").distinct()
    given = lambda df, c: df.where(F.col(c).isNotNull())
    if threshold <= 0:  # every pair of the page reaches it
        pairs = lu.join(ru, page) if null_as_literal else given(lu, "q").join(given(ru, "t"), page)
    else:
        raw_only = only is not None and set(only) <= {"raw_equal", "raw_contains"}
        pairs = page_candidates(given(lu, "q"), given(ru, "t"), page, threshold, raw_only)
        if null_as_literal:  # missing texts equal each other, and stand for the word
            named = lambda df, c: df.withColumn(c, F.coalesce(c, F.lit("None"))).distinct()
            word = page_candidates(named(lu, "q"), named(ru, "t"), page, threshold, raw_only)
            back = lambda c: F.explode(F.when(F.col(c) == "None", F.array(F.col(c), F.lit(None).cast("string"))).otherwise(F.array(c))).alias(c)
            pairs = word.select(*page, back("q"), "t").select(*page, "q", back("t"))
    scored = score_pairs(spread(pairs) if fuzzy_stage else pairs, "q", "t", fuzzy_stage, null_as_literal, threshold).where(F.col("score") >= threshold)
    if only:
        scored = scored.where(F.col("method").isin(*only))
    same = lambda a, b, cols: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols]
    hits = scored.alias("s").join(l.alias("l"), same("s", "l", [*page, "q"])).join(r.alias("r"), same("s", "r", [*page, "t"]))
    hits = hits.select(*[F.col(f"s.{c}").alias(c) for c in page], F.col("l.l").alias("l"), F.col("r.r").alias("r"), F.col("s.score").alias("score"), F.col("s.method").alias("method"), (F.col("l.lf") * len(right_fields) + F.col("r.rf")).alias("field_order"))
    return best_field(hits, [*page, "l", "r"])


def greedy(edge_rows: DataFrame) -> DataFrame:
    """For every l its best r (score, then the smaller r): many l may share an r."""
    best = F.row_number().over(Window.partitionBy("l").orderBy(F.desc("score"), "r"))
    return edge_rows.withColumn("_n", best).where("_n = 1").drop("_n")
