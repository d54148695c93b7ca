import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("TZ", "UTC")

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false"}
    s = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.fixture(scope="session")
def data():
    return DATA


def plain(frame):
    """Rows as sorted tuples of text, columns by name; floats to 6 digits."""
    import numpy as np
    import pandas as pd

    def one(v):
        if isinstance(v, (list, np.ndarray)):
            return str([one(x) for x in v])
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
            return "null"
        return repr(round(float(v), 6) + 0.0) if isinstance(v, (float, np.floating)) else str(v)

    return sorted(tuple(one(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def rows_of():
    return plain
