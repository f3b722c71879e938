"""Table access and lineage cuts shared by every query."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a scale directory; pruning and filters are left to Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only in local mode (tests), and only where it is unset, a temporary folder is made and
    set; on a cluster a missing setting is an error, as one machine's disk cannot be shared.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="attestra-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def materialize(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, never a recomputation, and
    several consumers do not run the plan above again. The table goes when the driver's JVM
    ends, or by :func:`discard`.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.attestra_path = path
    return out


def scratch(spark: SparkSession, label: str) -> str:
    """Path of a new folder in the shared folder; it goes when the driver's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/attestra-{label}-{uuid.uuid4().hex}"
    fs, where = _file_system(spark, path)
    fs.deleteOnExit(where)
    return path


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """One small file, on whatever file system the path names."""
    fs, where = _file_system(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def discard(*tables: DataFrame) -> None:
    """Remove tables of :func:`materialize` that nothing reads any more."""
    for t in tables:
        fs, where = _file_system(t.sparkSession, t.attestra_path)
        fs.delete(where, True)


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def local_path(uri: str) -> str:
    return uri[len("file://"):] if uri.startswith("file://") else uri


def drop_local(uri: str) -> None:
    """Remove a local folder made by :func:`shared_dir` (used by tests)."""
    path = local_path(uri)
    if os.path.isdir(path):
        shutil.rmtree(path, ignore_errors=True)
