from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TESTDATA = os.environ.get("TESSERA_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", f"file://{shared}").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    s.sparkContext.setLogLevel("OFF")
    from tessera.session import prepare

    yield prepare(s)
    s.stop()


@pytest.fixture(scope="session")
def sf(request):
    return f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def canon(df):
    """Rows as sorted tuples of text, columns in order of their names; doubles to nine digits."""
    import numpy as np

    def text(x):
        if x is None or isinstance(x, float) and x != x:
            return "-"
        if isinstance(x, (float, np.floating)):
            return "%.9g" % (x + 0.0)
        if isinstance(x, (list, tuple, np.ndarray)):
            return "[" + ",".join(map(text, x)) + "]"
        if isinstance(x, np.integer):
            return str(int(x))
        if isinstance(x, (bool, np.bool_)):
            return str(bool(x))
        return "-" if str(x) in ("NaT", "<NA>", "nan") else "%.9g" % x if isinstance(x, int) else str(x)

    cols = sorted(df.columns)
    return cols, sorted(tuple(text(x) for x in row) for row in df[cols].itertuples(index=False, name=None))
