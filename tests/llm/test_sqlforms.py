"""Queries with an SQL form give its rows on whole tables."""
import duckdb
import pytest

from tenetlog.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{FOLDER}/documents.parquet'")
    cur = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in cur.description]
    df = QUERIES[name](spark, FOLDER)
    assert sorted(columns) == sorted(df.columns)
    want = sorted(map(repr, cur.fetchall()))
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == want and want
