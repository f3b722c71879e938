import json

from attestra.plans import catalogue, pipelines


def test_every_analysis_names_known_queries():
    known = catalogue.queries()
    assert all(q in known for a in pipelines.ANALYSES.values() for q in a.values())


def test_export_and_verify(spark, small, tmp_path):
    tables = pipelines.results(spark, small, "audit")
    manifest = pipelines.export(tables, str(tmp_path / "out"), {"scale": "small"})
    assert json.loads((tmp_path / "out" / "manifest.json").read_text()) == manifest
    assert next((tmp_path / "out" / "estimate").glob("part*")).read_text().startswith("measure,estimate,standard_error,low,high\n")
    assert pipelines.verify(tables, manifest).count() == 0
    manifest["outputs"]["macro"]["digest"] = "0"
    manifest["outputs"]["gone"] = {"digest": "0", "rows": 1}
    del manifest["outputs"]["queue"]
    assert {tuple(r) for r in pipelines.verify(tables, manifest).collect()} == {("macro", "changed"), ("gone", "missing"), ("queue", "new")}
