"""Problem 4: one consistent form for text that looks the same.

Method: texts are exploded to positioned code points, mapped through a
decomposition table and a look-alike table, combining marks are put in the order
of their class, bases and marks are recomposed, and the strings are rebuilt.

The explosion is columnar: one Arrow batch becomes one flat array of code points
with row positions, and both mappings are dense arrays indexed by code point (a
broadcast hash join whose build side is the fixed Unicode repertoire, so its size
never depends on the data). No row of code points is ever shuffled. Texts made only
of visible ASCII and line feeds are their own form and stay in the JVM.

The form is a key to compare by, not a text to show: Cyrillic, Greek or kana that have a Latin or
Han twin come out in mixed scripts. Operators here hand on fingerprints of it or words of it, never the form.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.llm import pairs
from attestra.tables import materialize

# Letters and signs drawn with the same shape as the one they map to.
SAME_SHAPE = {
    # Cyrillic drawn like Latin
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ѵ": "v",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
    "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ү": "Y", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I", "Ѵ": "V",
    # Greek drawn like Latin
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "ρ": "p",
    # Greek drawn like Cyrillic
    "Γ": "Г", "Π": "П", "Φ": "Ф",
    # Cherokee drawn like Latin
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭵ": "i", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮞ": "4", "Ꮢ": "R",
    "Ꮤ": "W", "Ꮥ": "S", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ꮷ": "d", "Ᏼ": "B", "Ᏻ": "G", "Ꭹ": "y",
    # Lisu drawn like Latin
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S",
    "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    # Coptic drawn like Latin
    "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X",
    # Armenian and Latin variants
    "օ": "o", "ɡ": "g", "ɑ": "a",
    # katakana drawn like hiragana or kanji
    "ヘ": "へ", "ニ": "二", "カ": "力", "ロ": "口", "エ": "工", "タ": "夕", "ト": "卜", "ハ": "八", "ー": "一",
    # signs
    "‚": ",", "٫": ",", "ꓹ": ",", "‐": "-", "‑": "-", "ʼ": "’", "∶": ":", "꞉": ":", "։": ":", "∕": "/", "⁄": "/", "․": ".", "ꓸ": ".",
    "\t": " ", "\x85": "\n", "\u2028": "\n", "\u2029": "\n", "\r": "\n", "\x0b": "\n", "\x0c": "\n",
}
# Format signs that are visible, so they are kept.
VISIBLE_FORMAT = {0x600, 0x601, 0x602, 0x603, 0x604, 0x605, 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
# Invisible signs outside the category of format signs.
INVISIBLE = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
# Compatibility tags of forms that one can tell from the plain sign.
VISIBLE_TAGS = ("<super>", "<sub>", "<fraction>", "<circle>", "<square>", "<vertical>")
#: Code points that may have a mapping; outside lie only unified ideographs, Hangul syllables and private use.
MAPPED_RANGES = ((0, 0x3400), (0xA000, 0xAC00), (0xF900, 0x10000), (0x10000, 0x1F800), (0x2F800, 0x2FA20), (0xE0000, 0xE0200))
PLACEHOLDERS = ("", "-", "none", "null", "n/a")
#: A text without any of these is its own form.
PLAIN = r"[^\n -~]"
_ODD = re.compile(PLAIN)
_SIZE = 0x110000
_JAMO = re.compile("[\u1100-\u11ff]")


def _spell(ch: str) -> str:
    """Full decomposition by the forms that cannot be told apart by eye."""
    raw = unicodedata.decomposition(ch)
    if not raw:
        return ch
    parts = raw.split()
    if parts[0].startswith("<"):
        if parts[0] in VISIBLE_TAGS:
            return ch
        parts = parts[1:]
        if len(parts) > 1 and parts[0] == "0020":  # a spacing accent is visible, a blank plus mark is not the same
            return ch
    return "".join(_spell(chr(int(x, 16))) for x in parts)


@functools.lru_cache(maxsize=1)
def tables() -> dict:
    """Dense mapping arrays: target code point (or -1 dropped, -2 several), class, compositions."""
    target = np.arange(_SIZE, dtype=np.int32)
    ccc = np.zeros(_SIZE, dtype=np.uint8)
    several: dict[int, list[int]] = {}
    pairs: dict[int, int] = {}
    for lo, hi in MAPPED_RANGES:
        for c in range(lo, hi):
            ch = chr(c)
            if (cat := unicodedata.category(ch)) in ("Cs", "Cn", "Co"):
                continue
            ccc[c] = unicodedata.combining(ch)
            if c in INVISIBLE or (cat == "Cf" and c not in VISIBLE_FORMAT):
                target[c] = -1
                continue
            spelled = " " if cat == "Zs" else _spell(ch)
            out = [ord(SAME_SHAPE.get(x, x)) for x in spelled if ord(x) not in INVISIBLE and unicodedata.category(x) != "Cf"]
            if len(out) == 1:
                target[c] = out[0]
            else:
                target[c], several[c] = -2, out
            two = unicodedata.decomposition(ch).split()
            if len(two) == 2 and not two[0].startswith("<") and unicodedata.normalize("NFC", ch) == ch:
                pairs[int(two[0], 16) << 21 | int(two[1], 16)] = c
    # shapes are unified before marks are attached, so pairs must also exist for unified bases
    for k, to in list(pairs.items()):
        base = SAME_SHAPE.get(chr(k >> 21))
        if base and (u := ord(base) << 21 | k & 0x1FFFFF) not in pairs:
            pairs[u] = ord(SAME_SHAPE.get(chr(to), chr(to)))
    keys = np.array(sorted(pairs), dtype=np.int64)
    return {"target": target, "ccc": ccc, "several": several, "pair_keys": keys, "pair_to": np.array([pairs[k] for k in keys.tolist()], dtype=np.int32)}


def _recompose(cp: np.ndarray, row: np.ndarray, ccc: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
    """Order marks by class, then join each to the base before it where one sign exists."""
    n = len(cp)
    first = np.r_[True, row[1:] != row[:-1]]
    base_at = np.maximum.accumulate(np.where((ccc == 0) | first, np.arange(n), 0))
    if ((ccc[1:] > 0) & (ccc[:-1] > ccc[1:]) & ~first[1:]).any():
        order = np.lexsort((ccc, base_at))  # stable: equal classes keep their order
        cp, ccc = cp[order], ccc[order]
    marks = np.flatnonzero((ccc > 0) & (base_at != np.arange(n)))
    if not len(marks):
        return cp, row
    base = base_at[marks]
    rank = marks - base
    keep = np.ones(n, dtype=bool)
    blocked = np.zeros(n, dtype=np.uint8)
    keys, to = t["pair_keys"], t["pair_to"]
    for r in range(1, int(rank.max()) + 1):
        m = marks[rank == r]
        b = base_at[m]
        want = cp[b].astype(np.int64) << 21 | cp[m]
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        found = (keys[at] == want) & (ccc[b] == 0) & ((blocked[b] == 0) | (blocked[b] < ccc[m]))
        cp[b[found]] = to[at[found]]
        keep[m[found]] = False
        blocked[b[~found]] = ccc[m[~found]]
    return cp[keep], row[keep]


def canonical_texts(texts: list[str]) -> list[str]:
    """The consistent form of each text (no nulls), a whole batch at a time."""
    if not texts:
        return []
    t = tables()
    texts = [x.replace("\r\n", "\n") if "\r" in x else x for x in texts]
    texts = [unicodedata.normalize("NFC", x) if not x.isascii() and _JAMO.search(x) else x for x in texts]
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int32)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))
    cp = t["target"][flat]
    several = np.flatnonzero(cp == -2)
    if len(several):
        spelled = [t["several"][c] for c in flat[several].tolist()]
        reps = np.ones(len(cp), dtype=np.int64)
        reps[several] = [len(x) for x in spelled]
        ends = np.cumsum(reps)
        cp, row = np.repeat(cp, reps), np.repeat(row, reps)
        for at, out in zip((ends[several] - reps[several]).tolist(), spelled):
            cp[at : at + len(out)] = out
    keep = cp != -1
    if not keep.all():
        cp, row = cp[keep], row[keep]
    ccc = t["ccc"][cp] if len(cp) else np.zeros(0, dtype=np.uint8)
    if ccc.any():
        cp, row = _recompose(cp, row, ccc, t)
    joined = cp.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    cuts = np.searchsorted(row, np.arange(len(texts) + 1)).tolist()
    return [joined[a:b] for a, b in zip(cuts, cuts[1:])]


def canonical_or_null(texts: list[str | None]) -> list[str | None]:
    """For operators that are in Python already: nulls stay, plain texts are their own form."""
    out = list(texts)
    odd = [i for i, t in enumerate(out) if t and _ODD.search(t)]
    for i, form in zip(odd, canonical_texts([out[i] for i in odd])):
        out[i] = form
    return out


@F.pandas_udf(T.StringType())
def _canonical_udf(texts: pd.Series) -> pd.Series:
    known = texts.notna()
    out = pd.Series([None] * len(texts), dtype=object)
    if known.any():
        out[known.to_numpy()] = canonical_texts(texts[known].tolist())
    return out


def canonical(text: Column) -> Column:
    """Column form: null stays null, plain texts skip Python."""
    return F.when(text.rlike(PLAIN), _canonical_udf(F.when(text.rlike(PLAIN), text))).otherwise(text)


def is_placeholder(text: Column) -> Column:
    """True for null and for the words and signs that stand for null, in any case and with outer blanks."""
    return F.coalesce(F.lower(F.trim(text)).isin(*PLACEHOLDERS), F.lit(True))


def looks(values: DataFrame, id_col: str, group_cols: list[str], value_col: str) -> DataFrame:
    """id, group columns, fingerprints of the value (raw) and of its form (k1, k2); rows without a value are left out, repeated ones are one."""
    form = canonical(F.col(value_col))
    keys = values.where(F.col(value_col).isNotNull()).select(F.col(id_col).alias("id"), *group_cols, F.xxhash64(value_col).alias("raw"), form.alias("_form"))
    return keys.select("id", *group_cols, "raw", F.xxhash64("_form").alias("k1"), F.xxhash64(F.lit("form"), "_form").alias("k2")).distinct()


def same_look_pairs(values: DataFrame, id_col: str, group_cols: list[str], value_col: str) -> DataFrame:
    """Pairs of rows of a group whose values look the same but differ in characters.

    Returns the group columns, ``id_a`` < ``id_b``. Null values and null groups pair with nothing; rows with equal
    characters do not pair; an empty input gives no rows. Shuffles carry ids and 64-bit
    fingerprints only. Spellings of one form are paired first, then each pair of spellings is expanded to its rows, in
    blocks where a spelling has many, so equal values never meet.
    """
    by = [*group_cols, "k1", "k2"]
    keys = materialize(looks(values, id_col, group_cols, value_col), "forms")
    spellings = pairs.sizes(keys, [*by, "raw"])
    mixed = spellings.groupBy(*by).agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select(*by)
    spellings = materialize(spellings.join(mixed, by, "left_semi"), "spellings")
    rows = keys.join(spellings, [*by, "raw"], "left_semi")
    left = spellings.select(*by, F.col("raw").alias("raw_a"))
    counted = spellings
    two = left.join(spellings.select(*by, F.col("raw").alias("raw_b")), by).where("raw_a < raw_b")
    sides = {s: [f"{c}_{s}" for c in (*by, "raw")] for s in ("l", "r")}
    two = two.select(*[F.col(c).alias(f"{c}_{s}") for s in ("l", "r") for c in by], F.col("raw_a").alias("raw_l"), F.col("raw_b").alias("raw_r"), *group_cols)
    out = pairs.between(two, rows, counted, sides["l"], sides["r"], [*by, "raw"], keep=group_cols)
    return out.select(*group_cols, F.col("a").alias("id_a"), F.col("b").alias("id_b"))


def look_classes(values: DataFrame, id_col: str, group_cols: list[str], value_col: str) -> DataFrame:
    """One row per value: group columns, ``id_col``, class_id (fingerprint of the form in hex), rows and spellings of the class. Grows with the rows, not with their pairs."""
    keys = materialize(looks(values, id_col, group_cols, value_col), "forms")
    by = [*group_cols, "k1", "k2"]
    per = keys.groupBy(*by, "raw").agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("spellings"))
    return keys.join(per, by).select(*group_cols, F.col("id").alias(id_col), F.concat(F.lower(F.hex("k1")), F.lower(F.hex("k2"))).alias("class_id"), "rows", "spellings")
