"""Window functions, statements that write, transactions, and the ledger of migrations."""

import pytest

from millrace.functions.exprs import DialectError
from millrace.sources import ledger


def rows(engine, sql):
    return [tuple(r) for r in engine.sql(sql).collect()]


@pytest.fixture
def t(engine):
    engine.execute("CREATE TABLE t (g TEXT, x INTEGER, d DECIMAL(10,2)); INSERT INTO t VALUES ('a', 1, 1.50), ('a', 2, 2.50), ('a', 2, NULL), ('b', 5, 4.00), ('b', NULL, 1.00)")
    return engine


@pytest.mark.parametrize("value, want", [
    ("row_number() OVER (PARTITION BY g ORDER BY x, d)", [1, 2, 3, 1, 2]), ("rank() OVER (PARTITION BY g ORDER BY x)", [1, 2, 2, 1, 2]), ("dense_rank() OVER (ORDER BY g DESC)", [2, 2, 2, 1, 1]),
    ("lag(x) OVER (PARTITION BY g ORDER BY x, d)", [None, 1, 2, None, 5]), ("lead(x, 1, 0) OVER (PARTITION BY g ORDER BY x, d)", [2, 2, 0, None, 0]), ("sum(x) OVER (PARTITION BY g)", [5, 5, 5, 5, 5]), ("count(*) OVER ()", [5] * 5),
    ("sum(x) OVER (PARTITION BY g ORDER BY x, d ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)", [1, 3, 4, 5, 5]), ("max(x) OVER (PARTITION BY g ORDER BY x, d ROWS UNBOUNDED PRECEDING)", [1, 2, 2, 5, 5]), ("first_value(x) OVER (PARTITION BY g ORDER BY x, d)", [1, 1, 1, 5, 5]),
])
def test_windows(t, value, want):
    assert [r[-1] for r in rows(t, f"SELECT g, x, d, {value} AS v FROM t ORDER BY g, x, d")] == want


def test_a_window_over_groups(t):
    assert rows(t, "SELECT g, sum(x) AS s, rank() OVER (ORDER BY count(x) DESC) AS r FROM t GROUP BY g ORDER BY g") == [("a", 5, 1), ("b", 5, 2)]


@pytest.mark.parametrize("sql", ["SELECT row_number() OVER () FROM t", "SELECT nope(x) OVER () FROM t", "SELECT sum(g) OVER () FROM t", "UPDATE t SET nope = 1", "UPDATE t SET x = 1, x = 2", "COMMIT", "ROLLBACK", "COPY t TO 'x' (FORMAT nope)", "ALTER TABLE t ORDER BY nope"])
def test_refusals(t, sql):
    with pytest.raises(DialectError):
        t.execute(sql)


def test_update(t):
    assert t.execute("UPDATE t SET x = x * 10, g = 'z' WHERE x > 1").count == 3
    assert rows(t, "SELECT g, x FROM t ORDER BY g, x") == [("a", 1), ("b", None), ("z", 20), ("z", 20), ("z", 50)]
    assert t.execute("UPDATE t SET x = 0 WHERE x = 99").count == 0
    assert rows(t, "SELECT count(*) AS n FROM t AT VERSION 2 WHERE x > 1") == [(3,)]


def test_create_as_like_and_show(t):
    t.execute("CREATE TABLE u AS SELECT g, sum(d) AS s FROM t GROUP BY g; CREATE TABLE v LIKE u")
    assert rows(t, "SELECT count(*) AS n FROM u") == [(2,)] and rows(t, "SELECT * FROM v") == []
    said = rows(t, "SHOW CREATE TABLE u")[0][0]
    assert said == 'CREATE TABLE "u" ("g" TEXT, "s" DECIMAL(38,2)) ENGINE = append'
    t.execute("DROP TABLE u; " + said)


@pytest.mark.parametrize("form", ["csv", "ndjson"])
def test_copy_there_and_back(t, form, tmp_path):
    t.execute(f"COPY t TO '{tmp_path}/out' (FORMAT {form}); CREATE TABLE u LIKE t; COPY u FROM '{tmp_path}/out' (FORMAT {form})")
    assert rows(t, "SELECT * FROM u ORDER BY g, x, d") == rows(t, "SELECT * FROM t ORDER BY g, x, d")


def test_copy_of_a_query(t, tmp_path, spark):
    t.execute(f"COPY (SELECT g FROM t WHERE x = 5) TO '{tmp_path}/out.parquet'")
    assert [r.g for r in spark.read.parquet(f"{tmp_path}/out.parquet").collect()] == ["b"]


def test_transactions(t):
    before = t.store.versions()
    t.execute("BEGIN; INSERT INTO t VALUES ('c', 7, 1.00), ('c', 8, 1.00); DELETE FROM t WHERE x = 7")
    assert rows(t, "SELECT x FROM t WHERE g = 'c'") == [(8,)] and t.store.versions() == before
    t.execute("ROLLBACK")
    assert rows(t, "SELECT x FROM t WHERE g = 'c'") == []
    t.execute("BEGIN; INSERT INTO t VALUES ('c', 9, 1.00); DELETE FROM t WHERE x = 1; COMMIT")
    assert len(t.store.versions()) == len(before) + 1 and rows(t, "SELECT x FROM t WHERE g <> 'b' ORDER BY x") == [(2,), (2,), (9,)]


def test_order_by(t):
    t.execute("ALTER TABLE t ORDER BY (x)")
    assert t.store.table("t")["spec"]["order_by"] == ["x"] and rows(t, "SELECT count(*) AS n FROM t") == [(5,)]


def test_ledger(engine, tmp_path):
    folder = tmp_path / "steps"
    folder.mkdir()
    (folder / "2_rows.sql").write_text("INSERT INTO m VALUES (1)")
    (folder / "1_table.sql").write_text("CREATE TABLE m (a INTEGER)")
    assert [s.number for s in ledger.migrate(engine, str(folder), dry_run=True)] == [1, 2]
    assert [s.name for s in ledger.migrate(engine, str(folder))] == ["table", "rows"]
    assert ledger.migrate(engine, str(folder)) == [] and rows(engine, "SELECT a FROM m") == [(1,)]
    (folder / "2_rows.sql").write_text("INSERT INTO m VALUES (2)")
    with pytest.raises(DialectError, match="changed"):
        ledger.pending(engine, str(folder))
    (folder / "2_rows.sql").unlink()
    with pytest.raises(DialectError, match="gone"):
        ledger.pending(engine, str(folder))
