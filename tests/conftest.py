import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def same(got, want) -> None:
    """Two pandas frames hold the same rows, in any order; floats to 1e-5."""
    import pandas as pd

    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    a, b = (x[cols].copy() for x in (got, want))
    assert len(a) == len(b)
    for x in (a, b):
        for c in cols:
            if x[c].dtype.kind in "fiub":
                x[c] = pd.to_numeric(x[c]).astype(float).round(5)
            else:
                x[c] = x[c].map(str)
    a, b = (x.sort_values(cols, ignore_index=True) for x in (a, b))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, atol=2e-5)
