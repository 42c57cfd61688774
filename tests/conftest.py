import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def canonical(frame):
    """Rows as sorted tuples over columns by name, doubles to 9 digits."""
    import math

    import pandas as pd

    def cell(v):
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        if hasattr(v, "item") and not isinstance(v, (list, dict)) and getattr(v, "ndim", 0) == 0:
            v = v.item()
        if type(v).__name__ == "Decimal":
            v = float(v)
        if isinstance(v, bool):
            return int(v)
        if isinstance(v, float):
            return round(v, 7)
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, (list, tuple)):
            return tuple(cell(x) for x in v)
        return str(v)[:26] if hasattr(v, "isoformat") else v

    cols = sorted(frame.columns)
    return cols, sorted((tuple(cell(v) for v in row) for row in frame[cols].astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="session")
def same(spark, duck):
    def check(query, sql, sf_dir=DATA):
        got, want = canonical(query(spark, sf_dir).toPandas()), canonical(duck.execute(sql).df())
        assert got[0] == want[0]
        assert len(got[1]) == len(want[1])
        wrong = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
        assert not wrong, wrong[:3]

    return check
