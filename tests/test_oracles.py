"""Every query with SQL gives the SQL's rows."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from slidegrid.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(frame):
    frame = frame[sorted(frame.columns)]
    for c in frame:
        if frame[c].dtype.kind == "f":
            frame[c] = frame[c].round(6) + 0.0
    text = frame.astype(object).where(frame.notna(), None).map(lambda v: str(v.tolist() if hasattr(v, "tolist") else v))
    return sorted(map(tuple, text.itertuples(index=False)))


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES, key=lambda n: (list(registry.QUERIES).index(n))))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name not in registry.ORACLES:
        # these have tests of their values elsewhere; here they give rows, whole ones, of distinct names
        assert len(got) and len(set(got.columns)) == len(got.columns) and not got.isna().all().any()
        return
    want = duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    assert isinstance(want, pd.DataFrame)
