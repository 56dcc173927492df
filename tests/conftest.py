import os
import tempfile

import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def duck(sf_dir: str):
    """A DuckDB connection with a view for each table."""
    import duckdb

    con = duckdb.connect()
    for name in sorted(os.listdir(sf_dir)):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def same_rows(df, con, sql: str) -> None:
    """Holds a Spark result to DuckDB's, in any order; doubles to nine digits."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)

    def plain(v):
        if isinstance(v, float):
            return f"{v:.9g}" if v else "0"
        if isinstance(v, (list, tuple)):
            return str([plain(x) for x in v])
        return str(v)

    expected = sorted(tuple(map(plain, r)) for r in result.fetchall())
    found = sorted(tuple(map(plain, r)) for r in df.select(*names).collect())
    assert found == expected
