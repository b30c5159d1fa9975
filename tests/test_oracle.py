"""Each query against its SQL in DuckDB."""

import os

import pytest

from millrace import queries

DATA = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
if not os.path.isdir(DATA):
    pytest.skip("no tables", allow_module_level=True)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in queries.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda v: round(v, 6) if isinstance(v, float) else v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v
    return sorted(([cell(r[i]) for i in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", queries.queries())
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, DATA)
    cursor = duck.cursor()
    cursor.execute("SET TimeZone = 'UTC'")
    cursor.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert plain(df.collect(), df.columns) == plain(cursor.fetchall(), names)
