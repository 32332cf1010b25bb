import os
import sys

import pytest

os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [os.path.dirname(os.path.dirname(__file__)), os.environ.get("PYTHONPATH")]))
sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.buffer.pageSize", "2m")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df):
    """Rows of a pandas frame, columns by name, in one order and with one spelling of nulls and numbers."""

    def plain(x):
        if x is None or x != x:
            return ""
        if isinstance(x, float):
            return f"{round(x, 6):.6f}".rstrip("0").rstrip(".")
        return str(x.tolist() if hasattr(x, "tolist") else x)

    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(plain(x) for x in r) for r in df.where(df.notna(), None).itertuples(index=False))
