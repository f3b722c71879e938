import pytest

from attestra.plans import catalogue
from conftest import compare

QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, small, name):
    compare(spark, small, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark, small):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(ORACLES) <= set(__spark_entry__.queries())


def test_mass_is_conserved(spark, small):
    rows = QUERIES["q_alloc_distribution"](spark, small).groupBy("variant", "dimension").agg({"share": "sum"}).collect()
    assert rows and all(abs(r[2] - 1) < 1e-3 for r in rows)
