import os
import sys
from pathlib import Path

import pytest

TESTS = Path(__file__).resolve().parent
# executors import the package and, for functions that tests hand over, the test modules
for folder in (TESTS, TESTS.parent):
    sys.path.insert(0, str(folder))
    os.environ["PYTHONPATH"] = f"{folder}:{os.environ.get('PYTHONPATH', '')}"

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def duck(sf_dir: str):
    """DuckDB with the tables of a folder as views."""
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        path = f"{sf_dir}/{f}"
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def canonical(frame, columns):
    """Rows as sorted tuples of text; whole doubles read like integers."""

    def text(v):
        if v is None or v != v:
            return ""
        if isinstance(v, float) and abs(v) < 1e15 and v == int(v):
            return str(int(v))
        return str(round(v, 6)) if isinstance(v, float) else str(v)

    return sorted(tuple(text(v) for v in row) for row in frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False))


def same_as_sql(spark, name, queries, oracles, sf_dir=SMALL):
    got, want = queries[name](spark, sf_dir).toPandas(), duck(sf_dir).sql(oracles[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert canonical(got, columns) == canonical(want, columns)
