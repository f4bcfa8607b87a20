import os

import pytest

import __spark_entry__ as entry
from recollect.plans import catalog
from recollect.plans.adapters import TABLES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    plain = frame[columns].astype(object).where(frame[columns].notna(), None).astype(str)
    return columns, sorted(map(tuple, plain.values.tolist()))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_same_as_oracle(spark, duck, name):
    got = catalog.queries()[name](spark, DIR).toPandas()
    assert rows(got) == rows(duck.sql(catalog.oracle_sql()[name]).df())


def test_entry(spark):
    assert entry.entry(spark).columns == ["rank", "item_id", "line"]
