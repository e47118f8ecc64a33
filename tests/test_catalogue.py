import math

import duckdb
import pandas as pd
import pytest

from weirflow.plans.catalogue import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings".split():
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def _plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    return round(float(v), 4) if hasattr(v, "__float__") and not isinstance(v, str) else v


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    a, b = QUERIES[name](spark, DATA).toPandas(), con.execute(ORACLE_SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    rows = lambda df: sorted(repr(tuple(map(_plain, r))) for r in df[sorted(a.columns)].itertuples(index=False))
    assert rows(a) == rows(b)
