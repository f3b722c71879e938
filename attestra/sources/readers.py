"""Sources. Schemas are always given; nothing is inferred from the data."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.sources import sheets

# Texts a default CSV reader takes for missing.
MISSING = ("", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "#N/A", "n/a", "-nan", "-NaN", "<NA>", "#NA", "1.#IND", "1.#QNAN", "-1.#IND", "-1.#QNAN", "#N/A N/A")


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """One document per line; blank lines are skipped, malformed ones raise."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    """Whole-file JSON documents."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def _csv(spark: SparkSession, path: str, schema, multiline: bool) -> DataFrame:
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in T._parse_datatype_string(schema).fields]) if isinstance(schema, str) else T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    reader = spark.read.schema(text).option("header", True).option("escape", '"').option("nullValue", "\u0000").option("emptyValue", "").option("enforceSchema", False)
    return reader.option("multiLine", multiline).csv(path)


def _typed(df: DataFrame, schema) -> DataFrame:
    fields = (T._parse_datatype_string(schema) if isinstance(schema, str) else schema).fields
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if not isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in fields])


def read_csv_literal(spark: SparkSession, path: str, schema, multiline: bool = True) -> DataFrame:
    """Empty strings stay empty, NA stays the text NA. Typed columns are cast; what can't be cast raises."""
    raw = _csv(spark, path, schema, multiline)
    return _typed(raw.na.fill(""), schema)


def read_csv_missing(spark: SparkSession, path: str, schema, multiline: bool = True) -> DataFrame:
    """The usual words for missing values become null."""
    raw = _csv(spark, path, schema, multiline)
    return _typed(raw.select(*[F.when(~F.col(f"`{c}`").isin(*MISSING), F.col(f"`{c}`")).alias(c) for c in raw.columns]), schema)


def read_excel(spark: SparkSession, path: str, sheet: str, header: int, schema) -> DataFrame:
    """One sheet of a workbook: the columns of ``schema`` by their names in row ``header`` (from 0), empty cells null.

    The workbook is unpacked by the task that reads it. Cells hold what is stored, formulas their last value; what can't
    be cast raises; a missing sheet or column raises.
    """
    fields = (T._parse_datatype_string(schema) if isinstance(schema, str) else schema).fields

    def run(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows = list(sheets.cells(content, sheet))
                if len(rows) <= header:
                    continue
                place = {name: at for at, name in rows[header].items()}
                if missing := [f.name for f in fields if f.name not in place]:
                    raise ValueError(f"no columns {missing} in sheet {sheet}")
                body = [r for r in rows[header + 1 :] if r]
                yield pa.RecordBatch.from_arrays([pa.array([r.get(place[f.name]) for r in body], pa.string()) for f in fields], names=[f.name for f in fields])

    text = T.StructType([T.StructField(f.name, T.StringType()) for f in fields])
    return _typed(spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, text), schema)


def read_tree(spark: SparkSession, root: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """path (relative), length, content of all files under ``root`` but those with an excluded directory in their path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    scheme = "^[A-Za-z][A-Za-z0-9+.-]*:/*|^/+"
    base = re.sub(scheme, "", root.rstrip("/"))
    relative = F.substring(F.regexp_replace("path", scheme, ""), len(base) + 2, 1 << 20)
    out = files.select(relative.alias("path"), "length", "content")
    for name in excluded:
        out = out.where(~F.array_contains(F.split("path", "/"), name))
    return out


def read_hash_manifest(spark: SparkSession, path: str) -> DataFrame:
    """digest, path of lines ``digest  path``; blank lines are skipped."""
    parts = F.split(F.trim("value"), r"\s+", 2)
    return spark.read.text(path).where(F.trim("value") != "").select(parts[0].alias("digest"), parts[1].alias("path"))


def read_image_sizes(spark: SparkSession, path: str) -> DataFrame:
    """origin, width, height, channels."""
    return spark.read.format("image").option("dropInvalid", True).load(path).select("image.origin", "image.width", "image.height", F.col("image.nChannels").alias("channels"))
