"""Registered corpus queries against their SQL, exactly, on the smallest tables."""

import duckdb
import pandas as pd
import pytest
from barspan.llm import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query(name, spark, sf):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found, want = catalogue.QUERIES[name](spark, sf).toPandas(), con.sql(catalogue.ORACLE_SQL[name]).df()
    assert sorted(found.columns) == sorted(want.columns)

    def rows(frame):
        return sorted(tuple("" if v is None or v is pd.NA or v != v else repr(v.item() if hasattr(v, "item") else v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))

    assert [r.replace(".0'", "'") for r in map(str, rows(found))] == [r.replace(".0'", "'") for r in map(str, rows(want))]
