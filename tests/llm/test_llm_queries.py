import pytest

from attestra.llm import queries
from conftest import compare

QUERIES, ORACLES = queries.queries(), queries.oracle_sql()
COLUMNS = {
    "p1_found": "candidate_id final_code1", "p2_found": "table_name record_key segment language", "p3_found": "statement_id field_name record_id", "p4_found": "field_name id_a id_b",
    "p5_found": "record_id_a record_id_b", "p6_found": "language origin_type", "p7_ids": "doc_id ids", "p8_found": "source", "p9_found": "doc_id band",
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, small, name):
    compare(spark, small, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, small, name):
    out = QUERIES[name](spark, small)
    if name in COLUMNS:
        assert out.columns == COLUMNS[name].split()
    rows = out.collect()
    assert len(set(map(str, rows))) == len(rows)
    if name == "p8_found":
        assert "radio_transcript" in {r.source for r in rows}
    else:
        assert rows
