"""Every query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from quern.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind in "fiu":
            df[c] = df[c].astype(float).round(6)
        elif df[c].dtype == object:
            df[c] = df[c].map(lambda x: None if x is None or x != x else str(x))
    return sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(set(got.columns)) == len(got.columns)
    if name in ORACLES:
        want = con.sql(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert normal(got) == normal(want)
