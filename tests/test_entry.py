import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("PICTORIUM_TESTDATA", "/root/testdata/sf0.001")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DATA}/{file}'")
    got = entry.queries()[name](spark, DATA)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall()
    tidy = lambda rows: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=str)
    assert tidy([tuple(r[c] for c in cols) for r in got.collect()]) == tidy(want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_entry_runs(spark):
    assert entry.entry(spark).columns
