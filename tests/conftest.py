import glob
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from strandloom.session import ship_package

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return ship_package(session)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(SF + "/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.fixture(scope="session")
def same(spark, duck):
    """Compare a registered query with its SQL, rows in any order."""

    def rows(columns, values):
        order = sorted(range(len(columns)), key=columns.__getitem__)
        return sorted(str(tuple(v[i] for i in order)) for v in values)

    def check(query, sql):
        ours, theirs = query(spark, SF), duck.sql(sql)
        assert sorted(ours.columns) == sorted(theirs.columns)
        assert rows(ours.columns, ours.collect()) == rows(theirs.columns, theirs.fetchall())

    return check
