"""Sinks. Exports are small tables in a defined order; large results are written as partitioned parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT_SUFFIXES = ("csv", "json", "jsonl", "md", "txt", "py", "html", "css", "js", "yml", "yaml", "toml", "xml")


def significant(c: Column | str, digits: int = 12) -> Column:
    """A double as text with so many significant digits and no trailing zeros; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    plain = F.format_string(f"%.{digits}g", c)
    scientific = F.regexp_extract(plain, r"e([+-]\d+)$", 0)
    mantissa = F.regexp_replace(plain, r"e[+-]\d+$", "")
    short = F.when(F.contains(mantissa, F.lit(".")), F.regexp_replace(mantissa, r"\.?0+$", "")).otherwise(mantissa)
    return F.when(c.isNotNull(), F.concat(short, scientific))


def write_csv(df: DataFrame, path: str, order: list[str], digits: int | None = None, gzip: bool = False) -> None:
    """One ordered part file with a header and line feeds; doubles with ``digits`` significant digits if given."""
    out = df.orderBy(*order)
    if digits:
        out = out.select(*[significant(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema])
    out.coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").option("compression", "gzip" if gzip else "none").csv(path)


def write_json(df: DataFrame, path: str, order: list[str]) -> None:
    """One JSON document per row, keys sorted, nulls kept."""
    keys = sorted(df.columns)
    rows = df.orderBy(*order).select(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("value"))
    rows.coalesce(1).write.mode("overwrite").text(path)


def file_digests(files: DataFrame, suffixes: tuple[str, ...] = TEXT_SUFFIXES) -> DataFrame:
    """path, digest (SHA-256); text files by suffix are hashed with uniform line ends."""
    text = F.regexp_replace(F.decode("content", "UTF-8"), "\r\n", "\n")
    is_text = F.lower(F.substring_index("path", ".", -1)).isin(*suffixes)
    return files.select("path", F.when(is_text, F.sha2(F.encode(text, "UTF-8"), 256)).otherwise(F.sha2("content", 256)).alias("digest"))


def write_hash_manifest(digests: DataFrame, path: str) -> None:
    """Lines ``digest  path`` in path order."""
    digests.orderBy("path").select(F.concat("digest", F.lit("  "), "path").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def row_set_digest(df: DataFrame) -> DataFrame:
    """n and an order-independent digest of all rows: reproducible whatever the partitioning."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    half = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(half), F.lit(0).cast("decimal(38,0)")).cast("string").alias("digest"))
