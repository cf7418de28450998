"""Every query of the library's own operators against its SQL on the same tables."""

import datetime
import glob
import os

import duckdb
import pandas as pd
import pytest

from tidalframe import plans


@pytest.fixture(scope="session")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def ordered(d: pd.DataFrame) -> pd.DataFrame:
    d = d[sorted(d.columns)].copy()
    for c in d.columns:
        if d[c].dtype.kind == "f":
            d[c] = d[c] + 0.0
        elif d[c].dtype.kind == "M" or len(d) and isinstance(d[c].iloc[0], datetime.date):
            d[c] = pd.to_datetime(d[c]).astype("datetime64[us]")
    keys = [c for c in ("symbol", "datetime", "row_id", "fold", "role", "name", "a", "b") if c in d.columns]
    rest = [c for c in d.columns if c not in keys]
    return d.sort_values([*keys, *rest], key=lambda x: x.map(repr) if x.dtype == object else x).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_equals_sql(spark, sf, duck, name):
    got = plans.QUERIES[name](spark, sf)
    assert got.columns
    a, b = ordered(got.toPandas()), ordered(duck.execute(plans.ORACLES[name]).df())
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=0, atol=2e-6)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_runs(spark, sf, name):
    assert plans.QUERIES[name](spark, sf).count() > 0
