"""Every registered query of the engine gives the rows of its SQL."""

import os

import pytest

from trellis.plans import queries as core

duckdb = pytest.importorskip("duckdb")
DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DIR}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, db, name):
    df = core.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    if name not in core.oracle_sql():
        assert got
        return
    res = db.execute(core.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == columns
    assert got == sorted(repr(tuple(row[names.index(c)] for c in columns)) for row in res.fetchall())


def test_entry_imports_without_the_training_data_operators(spark):
    import __spark_entry__

    assert set(core.queries()) <= set(__spark_entry__.queries())
    assert set(core.oracle_sql()) <= set(__spark_entry__.oracle_sql())
