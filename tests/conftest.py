import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false", "spark.default.parallelism": "4"}
    session = SparkSession.builder.master("local[4]").appName("strata-tests").config(map=conf).getOrCreate()
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
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def canonical(pdf):
    """Rows as sorted text, columns by name, nulls alike."""
    import pandas as pd

    def cell(v):
        if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and getattr(v, "ndim", 0):
            return str(list(v))
        if pd.isna(v):
            return "null"
        if isinstance(v, float):
            return f"{v:.10g}"
        return f"{float(v):.10g}" if hasattr(v, "dtype") and v.dtype.kind == "f" else str(v)

    cols = sorted(pdf.columns)
    return cols, sorted(tuple(cell(v) for v in row) for row in pdf[cols].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def same():
    def check(df, relation):
        a, b = canonical(df.toPandas()), canonical(relation.df())
        assert a[0] == b[0]
        assert len(a[1]) == len(b[1])
        assert a[1] == b[1]

    return check
