"""Every recipe query runs; those with SQL give the rows that DuckDB gives."""

import duckdb
import pytest

from larder.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def _rows(frame, names):
    return sorted(map(repr, frame[names].astype(object).where(frame[names].notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name not in SQL:
        return
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "lineitem", "benchmark", "events"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got, sorted(got.columns)) == _rows(want, sorted(got.columns))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 50
    assert set(e.oracle_sql()) <= set(e.queries())
