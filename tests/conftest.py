import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(SF):
        if name.endswith(".parquet"):
            con.execute(f"create view {name[:-8]} as select * from read_parquet('{SF}/{name}')")
    return con


def same_rows(spark_df, duck_con, sql):
    """Column names and rows, in any order, are alike."""
    ours = spark_df.toArrow()
    theirs = duck_con.execute(sql).to_arrow_table() if hasattr(duck_con, "to_arrow_table") else duck_con.execute(sql).fetch_arrow_table()
    names = sorted(ours.column_names)
    assert names == sorted(theirs.column_names)
    plain = lambda t: sorted(tuple(str(r[c]) for c in names) for r in t.to_pylist())
    assert plain(ours) == plain(theirs)
