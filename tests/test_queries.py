"""Every registered query runs, and where it has SQL, gives what the SQL gives."""

import duckdb
import pandas as pd
import pytest
from barspan.plans import catalogue

import __spark_entry__

TABLES = "lineitem orders customer nation region part supplier events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(frame):
    """Comparable rows: columns by name, numbers to the last bit, in any order."""

    def cell(v):
        if v is None or v is pd.NA or v != v:
            return ""
        return repr(float(v)) if isinstance(v, (float, int)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(name, spark, sf, duck):
    found = catalogue.QUERIES[name](spark, sf).toPandas()
    assert len(found.columns)
    if name in catalogue.ORACLE_SQL:
        want = duck.sql(catalogue.ORACLE_SQL[name]).df()
        assert sorted(found.columns) == sorted(want.columns)
        assert rows(found) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    names = set(__spark_entry__.queries())
    assert set(catalogue.QUERIES) <= names and set(__spark_entry__.oracle_sql()) <= names
