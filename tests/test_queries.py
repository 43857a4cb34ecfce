"""Every registered event-log query against its SQL, on the smallest tables."""

import decimal

import duckdb
import pandas as pd
import pytest

from foldlog import plans

DATA = "/root/testdata/sf0.001"


def rows(df: pd.DataFrame) -> list:
    def plain(x):
        if x is None or (not isinstance(x, str) and pd.isna(x)):
            return None
        if isinstance(x, bool):
            return float(x)
        if isinstance(x, (int, float, decimal.Decimal)) or hasattr(x, "dtype"):
            return x if isinstance(x, pd.Timestamp) else round(float(x), 8)
        return str(x)

    return sorted(map(str, df[sorted(df.columns)].astype(object).map(plain).itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events conversations".split():
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_matches_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, DATA).toPandas()
    if name in plans.ORACLES:
        want = duck.sql(plans.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)
