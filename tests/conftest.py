import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

import pytest  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    from attestra.tables import drop_local, shared_dir

    drop_local(shared_dir(session))
    session.stop()


@pytest.fixture(scope="session")
def small():
    if not os.path.isdir(SMALL):
        pytest.skip("test tables are not here")
    return SMALL


def compare(spark, sf_dir, run, sql):
    """Rows of a query and of its oracle, with columns by name."""
    import glob

    import duckdb

    con = duckdb.connect()
    for p in glob.glob(sf_dir + "/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")

    def rows(frame):
        frame = frame[sorted(frame.columns)].astype(object)
        frame = frame.where(frame.notna(), None)
        return sorted(tuple("-" if v is None else f"{v:.5f}" if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False, name=None))

    mine, theirs = run(spark, sf_dir).toPandas(), con.sql(sql).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)
