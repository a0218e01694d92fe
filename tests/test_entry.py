"""The driver's contract, and the geometry queries against their SQL on small tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from polycell.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def canon(df):
    def one(v):
        if v is None or str(v) in ("nan", "<NA>", "NaN"):
            return None
        return int(v) if isinstance(v, float) and v == int(v) else v

    return sorted(str([one(v) for v in r]) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("supplier", "customer", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = c.execute(SQL[name]).df(), QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and canon(got) == canon(want)
