"""Scalar column expressions. Undefined values are NULL, never NaN; every ratio is a try_divide."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Weights of the commitment levels and of who decides, the signs of the direction.
ODR_WEIGHT = {"decision": 1.0, "proposal": 0.5}
DIRECTION_SIGN = {"increases": 1.0, "decreases": -1.0, "conditional": -0.25, "neutral": 0.0}
RELATION_WEIGHT = {"from_state": 1.0, "from_intermediary": 0.5, "not_applicable": 0.5}
DEFAULT_RELATION = 0.5
# Fixed value: two-sided 95 % quantile of the normal distribution.
Z95 = 1.959963984540054


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_ids(c: Column | str, sep: str = ";") -> Column:
    """List of the non-empty, trimmed parts of a joined id list; null gives an empty list."""
    parts = F.transform(F.split(F.coalesce(as_col(c), F.lit("")), sep), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def family(code: Column | str) -> Column:
    """First dotted part."""
    return F.substring_index(as_col(code), ".", 1)


def code_root(code: Column | str, kept_prefix: str | None = None) -> Column:
    """First two dotted parts; codes under ``kept_prefix`` stay whole."""
    c = as_col(code)
    root = F.substring_index(c, ".", 2)
    return root if kept_prefix is None else F.when(c.startswith(kept_prefix), c).otherwise(root)


def entity_prefix(doc_id: Column | str) -> Column:
    """Part of a document id before the first underscore."""
    return F.substring_index(as_col(doc_id), "_", 1)


def falsy(c: Column | str, default: Column) -> Column:
    """``c or default`` of dynamic languages for strings: null and empty fall through."""
    return F.coalesce(F.nullif(as_col(c), F.lit("")), default)


def first_text(*cols: Column | str) -> Column:
    """First non-empty of several texts, else the empty string."""
    return F.coalesce(*[F.nullif(as_col(c), F.lit("")) for c in cols], F.lit(""))


def clamp(c: Column | str, lo: int, hi: int) -> Column:
    """Null and 0 count as ``lo``; then limited to lo..hi."""
    return F.least(F.lit(hi), F.greatest(F.lit(lo), F.coalesce(as_col(c), F.lit(lo))))


def annotation(odr: str = "odr", direction: str = "privacy_direction", relation: str = "privacy_relation", strength: str = "strength") -> Column:
    """Struct that two statements must share to count as one annotation."""
    return F.struct(
        F.col(odr).alias("odr"),
        falsy(direction, F.lit("neutral")).alias("direction"),
        falsy(relation, F.lit("not_applicable")).alias("relation"),
        clamp(strength, 1, 3).cast("int").alias("strength"),
    )


def lookup(c: Column | str, table: Mapping[str, float], default: float | None) -> Column:
    """Constant lookup as a CASE expression (stays inside code generation)."""
    col = as_col(c)
    out = reduce(lambda acc, kv: acc.when(col == kv[0], F.lit(kv[1])), list(table.items())[1:], F.when(col == next(iter(table)), F.lit(next(iter(table.values())))))
    return out.otherwise(F.lit(default).cast("double"))


def keyword_hits(text: Column | str, patterns: Sequence[str]) -> Column:
    """Number of patterns with at least one match in the lower-cased text; null text has none."""
    low = F.lower(F.coalesce(as_col(text), F.lit("")))
    return reduce(lambda a, b: a + b, [low.rlike("(?U)" + p).cast("int") for p in patterns], F.lit(0))


def as_bool(c: Column | str) -> Column:
    """1, true, yes in any case and with outer blanks; everything else, null included, is false."""
    return F.coalesce(F.lower(F.trim(as_col(c).cast("string"))).isin("1", "true", "yes"), F.lit(False))


def truth_class(label: Column | str, positive: Sequence[str], excluded: Sequence[str]) -> Column:
    """Three-valued truth; null counts as the empty label."""
    c = F.coalesce(as_col(label), F.lit(""))
    return F.when(c.isin(*positive), "positive").when(c.isin(*excluded), "excluded").otherwise("negative")


def outcome(truth: Column | str, predicted: Column | str) -> Column:
    """TP, FN, FP, TN or excluded."""
    t, p = as_col(truth), as_col(predicted)
    return (
        F.when(t == "excluded", "excluded")
        .when((t == "positive") & p, "TP").when(t == "positive", "FN").when(p, "FP").otherwise("TN")
    )


def calibrate(value: Column, lo: Column, mid: Column, hi: Column) -> Column:
    """Piecewise-linear map of lo, mid, hi to .05, .5, .95, clipped to .01 and .99."""
    up = 0.5 + 0.45 * F.least(F.lit(1.0), F.try_divide(value - mid, hi - mid))
    down = 0.05 + 0.45 * F.greatest(F.lit(0.0), F.try_divide(value - lo, mid - lo))
    return F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.when(value >= mid, up).otherwise(down)))


def gated(value: Column, gate: Column, floor: float = 0.35) -> Column:
    """``value`` scaled between ``floor`` and 1 by a gate in 0..1."""
    return value * (floor + (1 - floor) * gate)


def argmax_name(names: Sequence[str]) -> Column:
    """Name of the column with the greatest value; the first wins ties; null if all are null."""
    cols = F.array(*[F.col(n) for n in names])
    return F.when(F.greatest(*names).isNotNull(), F.element_at(F.array(*map(F.lit, names)), F.array_position(cols, F.greatest(*names)).cast("int")))


def second_largest(names: Sequence[str]) -> Column:
    return F.try_element_at(F.sort_array(F.array(*[F.col(n) for n in names]), asc=False), F.lit(2))


def wilson(successes: Column, trials: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of the score interval; null for no trials."""
    n = trials.cast("double")
    p = F.try_divide(successes.cast("double"), n)
    centre = F.try_divide(p + F.try_divide(F.lit(z * z / 2), n), 1 + F.try_divide(F.lit(z * z), n))
    half = F.try_divide(z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z / 4), n * n)), 1 + F.try_divide(F.lit(z * z), n))
    return centre - half, centre + half


def f1(precision: Column, recall: Column) -> Column:
    """Harmonic mean; 0 where it is undefined."""
    return F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))


def names_english(label: Column | str) -> Column:
    """Whether a language label names English by code, code with region or name, in any case; null does not."""
    return F.coalesce(F.lower(F.trim(as_col(label))).rlike("^(en|eng|english)([-_][a-z0-9]+)*$"), F.lit(False))


def seed_of(text: Column | str) -> Column:
    """First 16 hex digits of the SHA-256 as an unsigned whole number."""
    return F.conv(F.substring(F.sha2(as_col(text), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def text_digest(content: Column | str) -> Column:
    """SHA-256 of text whose line ends were made uniform."""
    return F.sha2(F.regexp_replace(as_col(content), "\r\n?", "\n"), 256)


_NOT_WORD = re.compile(r"\W+")


def _normalize(s: str) -> str:
    return _NOT_WORD.sub(" ", unicodedata.normalize("NFKC", s.casefold())).strip()


def _span(s: str) -> str:
    s = unicodedata.normalize("NFKC", s).replace("­", "").replace("-\n", "")
    return "".join(s.split())


@F.pandas_udf(T.StringType())
def _normalize_udf(s: pd.Series) -> pd.Series:
    return s.map(_normalize, na_action="ignore")


@F.pandas_udf(T.StringType())
def _span_udf(s: pd.Series) -> pd.Series:
    return s.map(_span, na_action="ignore")


def normalize_text(c: Column | str) -> Column:
    """Casefold, NFKC, runs of other than word characters to one blank. ASCII texts stay in the JVM."""
    col = as_col(c)
    ascii_ = F.trim(F.regexp_replace(F.lower(col), r"[^a-z0-9_]+", " "))
    other = col.rlike(r"[^\x00-\x7F]")
    return F.when(other, _normalize_udf(F.when(other, col))).otherwise(ascii_)


def normalize_span(c: Column | str) -> Column:
    """NFKC without soft hyphens, with words broken at line ends joined and all blanks removed."""
    col = as_col(c)
    ascii_ = F.regexp_replace(F.regexp_replace(col, "-\n", ""), r"[\s\x1c-\x1f]+", "")
    other = col.rlike(r"[^\x00-\x7F]")
    return F.when(other, _span_udf(F.when(other, col))).otherwise(ascii_)
