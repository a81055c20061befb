"""Every registered query has the shape of its SQL form; a spread of them is compared."""
import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
COMPARED = ["current_values_with_lineage", "values_as_of", "belief_history", "value_admission", "corrupted_log_audit",
            "claim_candidates", "candidate_endings", "belief_status", "literal_declarations", "report_details", "membership_proofs"]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return con


def test_every_sql_belongs_to_a_query(duck):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    for name, sql in entry.oracle_sql().items():
        assert duck.execute(f"DESCRIBE {sql}").fetchall(), name


@pytest.mark.parametrize("name", COMPARED)
def test_query_equals_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    cur = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(repr(r) for r in cur.fetchall())
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    assert got == want and got


WHOLE = ["current_values", "current_values_with_lineage", "events_in_order", "support_members", "support_arrays"]


@pytest.mark.parametrize("name", WHOLE)
def test_value_views_cover_the_whole_table(spark, name):
    folder, con = "/root/testdata/sf0.01", duckdb.connect()
    con.execute(f"create view events as select * from '{folder}/events.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    want = sorted(repr(r) for r in cur.fetchall())
    rows = entry.queries()[name](spark, folder).collect()
    assert sorted(repr(tuple(r[c] for c in columns)) for r in rows) == want
    if name.startswith(("events", "support_members")):
        assert len(rows) == con.execute("select count(*) from events").fetchone()[0]
