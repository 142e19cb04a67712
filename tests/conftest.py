import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def same_rows(frame, other) -> None:
    """Spark's and DuckDB's rows, in any order, with numbers to nine digits."""
    import pandas as pd

    assert sorted(frame.columns) == sorted(other.columns)
    columns = sorted(frame.columns)

    def plain(x):
        if isinstance(x, (bool,)) or hasattr(x, "item"):
            x = x.item() if hasattr(x, "item") else x
        if x is None or (not isinstance(x, str) and pd.isna(x)):
            return None
        return round(float(x), 9) if isinstance(x, (int, float)) else x

    rows = [sorted(repr([plain(x) for x in r]) for r in f[columns].itertuples(index=False)) for f in (frame, other)]
    assert rows[0] == rows[1]
