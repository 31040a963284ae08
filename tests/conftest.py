from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

TOP = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, TOP)
os.environ["PYTHONPATH"] = f"{TOP}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def same_rows(spark_df, con, sql: str) -> None:
    """Equal rows in any order, columns by name."""
    got = spark_df.toPandas()
    want = con.sql(sql).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    as_rows = lambda df: sorted(tuple(map(str, r)) for r in df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False))
    assert as_rows(got) == as_rows(want)
