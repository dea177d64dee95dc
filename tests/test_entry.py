import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from cairnspark.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return con


def told(x: pd.DataFrame) -> list[tuple]:
    x = x[sorted(x.columns)]
    cell = lambda v: None if v is None or v is pd.NA or v != v else f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(str, (cell(v) for v in r))) for r in x.itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
@pytest.mark.parametrize("name", catalog.SQL)
def test_against_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, DIR).toPandas(), duck.execute(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and told(got) == told(want)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
