"""Every registered query against its SQL on the smallest tables, and the driver's contract."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from urbanspark import catalogue


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def canon(rows):
    def one(v):
        if v is None or v != v:
            return "null"
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(name, spark, db, small):
    got = catalogue.QUERIES[name](spark, small)
    want = db.sql(catalogue.SQL[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    quoted = ", ".join(f'"{n}"' for n in names)
    assert canon(got.select(*names).collect()) == canon(db.sql(f"select {quoted} from ({catalogue.SQL[name]})").fetchall())


def test_contract(spark):
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and set(catalogue.QUERIES) <= set(queries)
    assert entry.entry(spark).count() == 1250
