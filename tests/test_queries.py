"""Every registered query against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from planlens import queries as base

FUNCTIONS, SQL = base.queries(), base.oracle_sql()


@pytest.fixture(scope="module")
def oracle(data):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f).removesuffix('.parquet')} AS SELECT * FROM '{f}'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    value = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(columns), sorted(tuple(repr(value(r[k])) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(FUNCTIONS))
def test_query(spark, data, oracle, name):
    frame = FUNCTIONS[name](spark, data)
    got = plain([tuple(r) for r in frame.collect()], frame.columns)
    assert got[1] or name in ("p22_tenant_guard",)
    if name in SQL:
        found = oracle.execute(SQL[name])
        assert got == plain(found.fetchall(), [d[0] for d in found.description])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
