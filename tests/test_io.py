import gzip
import hashlib

import pytest

from attestra.operators import expectations
from attestra.sources import readers, sheets, writers
from attestra.streaming import ingest


def test_csv_readers(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_bytes('﻿k,v,n\nNA,"two\nlines ""q""",1\n,None,\n'.encode())
    lit = readers.read_csv_literal(spark, str(f), "k string, v string, n string").collect()
    assert [tuple(r) for r in lit] == [("NA", 'two\nlines "q"', "1"), ("", "None", "")]
    mis = readers.read_csv_missing(spark, str(f), "k string, v string, n int").collect()
    assert [tuple(r) for r in mis] == [(None, 'two\nlines "q"', 1), (None, None, None)]
    with gzip.open(tmp_path / "b.csv.gz", "wt") as g:
        g.write("k,n\nx,2\n")
    assert readers.read_csv_missing(spark, str(tmp_path / "b.csv.gz"), "k string, n int").collect()[0].n == 2


def test_json_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a int").count() == 2
    (tmp_path / "b.json").write_text('{\n "a": {"b": [1, 2]}\n}')
    assert readers.read_json(spark, str(tmp_path / "b.json"), "a struct<b:array<int>>").collect()[0].a.b == [1, 2]


def test_writers_and_manifests(spark, tmp_path):
    df = spark.createDataFrame([("b", 1 / 3), ("a", 100000.0), ("c", 1e-20), ("d", None)], "k string, x double")
    writers.write_csv(df, str(tmp_path / "csv"), ["k"], digits=12)
    part = next((tmp_path / "csv").glob("part*"))
    assert part.read_text() == "k,x\na,100000\nb,0.333333333333\nc,1e-20\nd,\n"
    writers.write_json(df, str(tmp_path / "json"), ["k"])
    assert next((tmp_path / "json").glob("part*")).read_text().splitlines()[-1] == '{"k":"d","x":null}'
    tree = tmp_path / "tree"
    (tree / "skip").mkdir(parents=True)
    (tree / "a.txt").write_bytes(b"x\r\ny\n")
    (tree / "b.bin").write_bytes(b"x\r\ny\n")
    (tree / "skip" / "c.txt").write_text("no")
    digests = writers.file_digests(readers.read_tree(spark, str(tree), ("skip",)))
    got = {r.path: r.digest for r in digests.collect()}
    assert got == {"a.txt": hashlib.sha256(b"x\ny\n").hexdigest(), "b.bin": hashlib.sha256(b"x\r\ny\n").hexdigest()}
    writers.write_hash_manifest(digests, str(tmp_path / "sums"))
    back = readers.read_hash_manifest(spark, str(tmp_path / "sums"))
    assert expectations.manifest_diff(back, digests, "path", "digest").count() == 0


def test_excel_sheets(spark, tmp_path):
    rows = [["ab", 1.5, True, None], [None, 2, False, "x < y & z"], ["", None, None, " padded "]]
    (tmp_path / "b.xlsx").write_bytes(sheets.workbook("Data & more", ["k", "n", "flag", "t"], rows, above=1))
    schema = "t string, n double, k string, flag boolean"
    got = [tuple(r) for r in readers.read_excel(spark, str(tmp_path / "b.xlsx"), "Data & more", 1, schema).collect()]
    assert got == [(None, 1.5, "ab", True), ("x < y & z", 2.0, None, False), (" padded ", None, None, None)]
    content = (tmp_path / "b.xlsx").read_bytes()
    assert list(sheets.cells(content, "Data & more"))[0] == {}
    (tmp_path / "e.xlsx").write_bytes(sheets.workbook("s", ["k"], []))
    assert readers.read_excel(spark, str(tmp_path / "e.xlsx"), "s", 0, "k string").count() == 0
    assert [sheets._column(c) for c in ("A1", "Z9", "AA10", "AB2")] == [0, 25, 26, 27] and [sheets._letters(c) for c in (0, 25, 26, 27)] == ["A", "Z", "AA", "AB"]
    for sheet, wanted in (("other", "k string"), ("s", "missing string")):
        with pytest.raises(Exception):
            readers.read_excel(spark, str(tmp_path / "e.xlsx"), sheet, 0, wanted).collect()


def test_row_set_digest_ignores_order(spark):
    df = spark.createDataFrame([(i, str(i)) for i in range(50)], "a int, b string")
    assert writers.row_set_digest(df).collect() == writers.row_set_digest(df.repartition(3).orderBy("b")).collect()
    assert writers.row_set_digest(df.limit(0)).collect()[0].n == 0


def test_stream_equals_batch(spark, small, tmp_path):
    import shutil

    (tmp_path / "in").mkdir()
    shutil.copy(f"{small}/events.parquet", tmp_path / "in" / "e.parquet")
    schema = spark.read.parquet(f"{small}/events.parquet").schema
    q = ingest.hourly_stream(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "cp"), late="0 seconds")
    q.awaitTermination(120)
    out = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("hour", "event_type", "n", "total").collect()}
    batch = {tuple(r) for r in ingest.hourly_batch(spark, small).collect()}
    assert out <= batch and len(out) > 0.5 * len(batch)
