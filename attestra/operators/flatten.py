"""Nested response documents to statements, and the merges that precede analysis."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.functions.scalars import falsy, names_english, split_ids

STATEMENT = "struct<block_id:string,quote:string,quote_en:string,code1:string,odr:string,privacy_direction:string,privacy_relation:string,strength:int,source_mode:string>"
RESPONSE_SCHEMA = f"request_id string, units array<struct<unit_id:string,status:string,statements:array<{STATEMENT}>>>"


def flatten(responses: DataFrame, provider: str) -> DataFrame:
    """One row per statement with its 1-based place and the id provider:unit:Snnn.

    Null and empty unit or statement lists give no rows.
    """
    units = responses.select("request_id", F.explode("units").alias("u"))
    rows = units.select("request_id", F.col("u.unit_id").alias("unit_id"), F.col("u.status").alias("status"), F.posexplode("u.statements").alias("pos", "s"))
    named = F.format_string("%s:%s:S%03d", F.lit(provider), F.col("unit_id"), F.col("pos") + 1)
    return rows.select(named.alias("statement_id"), F.lit(provider).alias("provider"), "request_id", "unit_id", "status", (F.col("pos") + 1).alias("ordinal"), "s.*")


def with_units(statements: DataFrame, units: DataFrame, columns: list[str]) -> DataFrame:
    """Adds attributes of the unit; statements of unknown units are dropped (see ``missing_keys``)."""
    return statements.join(units.select("unit_id", *columns), "unit_id")


def candidate_statements(candidates: DataFrame, id_cols: dict[str, str]) -> DataFrame:
    """candidate_id, provider, statement_id from one joined id list per provider."""
    lists = F.array(*[F.struct(F.lit(p).alias("provider"), split_ids(c).alias("ids")) for p, c in id_cols.items()])
    per = candidates.select("candidate_id", F.explode(lists).alias("l")).select("candidate_id", "l.*")
    return per.select("candidate_id", "provider", F.explode("ids").alias("statement_id"))


def retry_merge(main: DataFrame, retry: DataFrame, key: str, succeeded) -> DataFrame:
    """Whole rows of ``retry`` that succeeded replace those of ``main``; keys only in retry are not added."""
    good = retry.where(succeeded).select(F.col(key), F.struct(*main.columns).alias("_retry"))
    both = main.select(key, F.struct(*main.columns).alias("_main")).join(good, key, "left")
    return both.select(F.col("_retry").isNotNull().alias("replaced"), F.coalesce("_retry", "_main").alias("x")).select("replaced", "x.*")


def drop_translation(statements: DataFrame, language: str) -> DataFrame:
    """Nulls the translation of statements whose language label names English, in any notation; an unknown language keeps it."""
    return statements.withColumn("quote_en", F.when(names_english(language), F.lit(None)).otherwise(F.col("quote_en")))


def paginate(texts: DataFrame, id_col: str, text_col: str, budget: int) -> DataFrame:
    """Units of at most ``budget`` characters, cut before a blank where possible: id, ordinal, piece.

    A text within the budget is one unit, a null or empty one has an empty piece; no character is lost or added.
    """
    pattern = rf"(?s)(.{{1,{budget}}}(?=[ \t\n\x0B\f\r]|\z)|.{{1,{budget}}})"
    pieces = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(pattern), 1)
    return texts.select(id_col, F.posexplode(F.when(F.size(pieces) == 0, F.array(F.lit(""))).otherwise(pieces)).alias("ordinal", "piece"))


@F.pandas_udf(T.StructType([T.StructField("status", T.StringType()), T.StructField("span", T.StringType())]))
def _restore(quote: pd.Series, source: pd.Series) -> pd.DataFrame:
    out = []
    for q, s in zip(quote, source):
        bare_q = "".join((q or "").split())
        places = [i for i, ch in enumerate(s or "") if not ch.isspace()]
        bare = "".join(s[i] for i in places) if s else ""
        at = bare.find(bare_q) if bare_q else -1
        if at < 0:
            out.append(("unsupported", None))
        elif bare.find(bare_q, at + 1) >= 0:
            out.append(("ambiguous", q))
        else:
            out.append(("restored", s[places[at] : places[at + len(bare_q) - 1] + 1]))
    return pd.DataFrame(out, columns=["status", "span"])


def canonical_quotes(rows: DataFrame, quote: str, source: str, rendered: str | None = None) -> DataFrame:
    """Adds status and span: exact part of the source, restored from it without regard to blanks, ambiguous, render or unsupported.

    Only rows that are no exact part of their source reach Python.
    """
    exact = F.coalesce(F.contains(F.col(source), F.col(quote)) & (F.col(quote) != ""), F.lit(False))
    fix = _restore(F.when(~exact, F.col(quote)), F.when(~exact, F.col(source)))
    out = rows.withColumn("_fix", fix)
    status = F.when(exact, F.lit("exact")).otherwise(F.col("_fix.status"))
    if rendered is not None:
        status = F.when((status == "unsupported") & F.col(rendered), "render").otherwise(status)
    return out.select(*rows.columns, status.alias("quote_status"), F.when(exact, F.col(quote)).otherwise(F.col("_fix.span")).alias("quote_span"))


def change_log(before: DataFrame, after: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Count of each transition of a column between two versions of a table; rows of one side only show null on the other."""
    b = before.select(*keys, F.col(column).alias("old"))
    a = after.select(*keys, F.col(column).alias("new"))
    return b.join(a, keys, "full").groupBy("old", "new").agg(F.count(F.lit(1)).alias("n"))


__all__ = ["flatten", "with_units", "candidate_statements", "retry_merge", "drop_translation", "paginate", "canonical_quotes", "change_log", "falsy"]
