"""What came to the dialect later, and what reads and writes around it: files, gaps, as-of joins, lists, search, upkeep, traces, streams."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions.exprs import DialectError
from millrace.operators import relational
from millrace.plans import analysis
from millrace.plans.binder import Engine
from millrace.streaming import windows


def rows(engine, sql):
    return [tuple(r) for r in engine.sql(sql).collect()]


def test_files_as_tables(engine, spark, tmp_path):
    (tmp_path / "a1.csv").write_text('id,note\n1,"x, y"\n2,\n')
    (tmp_path / "a2.csv").write_text("id,note\n3,z\n")
    (tmp_path / "log.ndjson").write_text('{"level": "error", "at": {"host": "h1", "n": 2}}\n{"level": "info", "at": {"host": "h2"}}\n')
    assert rows(engine, f"FROM '{tmp_path}/a*.csv' SELECT id, note ORDER BY id") == [(1, "x, y"), (2, None), (3, "z")]
    assert rows(engine, f"SELECT at.* FROM '{tmp_path}/log.ndjson' WHERE level = 'error'") == [("h1", 2)]
    assert rows(engine, f"SELECT f.level FROM '{tmp_path}/log.ndjson' AS f ORDER BY f.level DESC LIMIT 1") == [("info",)]
    with pytest.raises(DialectError):
        engine.sql(f"FROM '{tmp_path}/a.xyz'")


def test_paths(engine):
    engine.execute('CREATE TABLE s ("a.x" INTEGER, "a.b.y" INTEGER, "ab.z" INTEGER, w INTEGER); INSERT INTO s VALUES (1, 2, 3, 4)')
    assert rows(engine, "SELECT a.* FROM s") == [(1, 2)] and rows(engine, "SELECT a.b.* FROM s") == [(2,)]
    assert rows(engine, "SELECT * EXCLUDE (a.*, w) FROM s") == [(3,)] and rows(engine, "SELECT s.* EXCLUDE (ab.z) FROM s") == [(1, 2, 4)]


@pytest.mark.parametrize("fill, want", [
    ("0", [(None, 0, 5.0), (None, 2, 6.0), (None, 1, 0.0), ("k", 1, 3.0)]), ("previous", [(None, 0, 5.0), (None, 1, 5.0), (None, 2, 6.0), ("k", 1, 3.0)]),
    ("linear", [(None, 0, 5.0), (None, 1, 5.5), (None, 2, 6.0), ("k", 1, 3.0)]),
])
def test_gaps_of_null_groups(engine, fill, want):
    engine.execute("CREATE TABLE g (k TEXT, t TIMESTAMP, v INTEGER); INSERT INTO g VALUES (NULL, TIMESTAMP '2024-01-01 00:10:00', 5), "
                   "(NULL, TIMESTAMP '2024-01-01 02:10:00', 6), ('k', TIMESTAMP '2024-01-01 01:00:00', 3), ('q', NULL, 9)")  # fmt: skip
    got = rows(engine, f"SELECT k, time_bucket(INTERVAL '1 hour', t) AS b, sum(v) AS v FROM g GROUP BY k, b FILL {fill}")
    assert ("q", None, 9.0) in got
    assert sorted(((k, b.hour, float(v)) for k, b, v in got if b), key=repr) == sorted(want, key=repr)


def test_nearest_join_of_nulls(engine):
    engine.execute("CREATE TABLE l (k INTEGER, t INTEGER, n INTEGER); INSERT INTO l VALUES (1, 5, 1), (1, 1, 2), (NULL, 5, 3), (1, NULL, 4), (2, 9, 5);"
                   "CREATE TABLE r (k INTEGER, t INTEGER, v TEXT); INSERT INTO r VALUES (1, 3, 'a'), (1, 5, 'b'), (NULL, 1, 'x'), (2, NULL, 'y'), (1, NULL, 'z')")  # fmt: skip
    assert rows(engine, "SELECT l.n, r.v FROM l NEAREST JOIN r ON l.k = r.k AND l.t >= r.t") == [(1, "b")]
    assert sorted(rows(engine, "SELECT l.n, r.v FROM l LEFT NEAREST JOIN r ON r.t <= l.t AND l.k = r.k")) == [(1, "b"), (2, None), (3, None), (4, None), (5, None)]


def test_nearest_join_against_all_pairs(spark):
    r = random.Random(2)
    some = lambda *x: r.choice([*x, None])
    left = [(i, some(1, 2), some(*range(9))) for i in range(80)]
    right = list({(some(1, 2), some(*range(9))): i for i in range(60)}.items())
    one = spark.createDataFrame(left, "i int, k int, t int")
    two = spark.createDataFrame([(k, t, v) for (k, t), v in right], "k int, u int, v int")
    got = {x.i: x.v for x in relational.nearest_join(one, two, ["k"], "t", "u", ["v"]).collect()}
    for i, k, t in left:
        fit = [(u, v) for (k2, u), v in right if k is not None and k == k2 and u is not None and t is not None and u <= t]
        assert got[i] == (max(fit)[1] if fit else None)


def test_lists(engine):
    assert rows(engine, "SELECT list_map([1, 2, NULL], x -> x * 10) AS a, list_filter(['a', 'bb'], s -> length(s) > 1) AS b, list_map([], x -> 1) AS c") == [([10, 20, None], ["bb"], [])]
    assert rows(engine, "SELECT list_map(list_filter([1, 2, 3], x -> x <> 2), y -> y + 0.5) AS a") == [([1.5, 3.5],)]
    engine.execute("CREATE TABLE v (k INTEGER, xs LIST<BIGINT>); INSERT INTO v VALUES (1, [7, 8]), (2, NULL), (3, [])")
    assert rows(engine, "SELECT k, unnest(xs) AS x FROM v ORDER BY x") == [(1, 7), (1, 8)]
    assert rows(engine, "SELECT k, list_map(xs, x -> x + k) AS x FROM v WHERE k < 3 ORDER BY k") == [(1, [8, 9]), (2, None)]


def test_search(engine):
    engine.execute("CREATE TABLE d (id INTEGER, body TEXT); INSERT INTO d VALUES (1, 'Red fox, red hen'), (2, 'a fox'), (3, 'hen'), (4, NULL), (5, '')")
    assert [r[0] for r in rows(engine, "SELECT id, score() AS s FROM d WHERE MATCH(body, 'RED') ORDER BY s DESC")] == [1]
    assert [r[0] for r in rows(engine, "SELECT id FROM d WHERE MATCH(body, 'fox red') ORDER BY score() DESC")] == [1, 2]
    assert rows(engine, "SELECT id FROM d WHERE MATCH(body, '')") == []


def test_networks(engine, spark):
    ips = ["10.1.2.3", "10.128.0.1", "192.168.0.7"]
    data = [(i, bytes(10) + b"\xff\xff" + bytes(map(int, i.split(".")))) for i in ips] + [("::1", bytes(15) + b"\1"), (None, None)]
    engine.register("n", spark.createDataFrame(data, "s string, ip binary"))
    for net, want in (("10.0.0.0/8", ips[:2]), ("10.0.0.0/9", ips[:1]), ("192.168.0.7/32", ips[2:]), ("0.0.0.0/0", ips), ("::/64", ["::1", *ips]), ("::1/128", ["::1"])):
        assert sorted(r[0] for r in rows(engine, f"SELECT s FROM n WHERE in_network(ip, '{net}')")) == sorted(want)


def test_explain_alter(engine):
    engine.execute("CREATE TABLE a (x INTEGER, y TEXT); INSERT INTO a VALUES (1, 'p'); INSERT INTO a VALUES (2, 'q')")
    (order,) = engine.sql("EXPLAIN ALTER TABLE a ORDER BY (y)").collect()
    assert (order.change, order.segments, order.rewrites) == ("order by", 2, 2) and order.rewrite_bytes > 0
    assert [r[2] for r in rows(engine, "EXPLAIN ALTER TABLE a ADD COLUMN z INTEGER")] == [0] and engine.store.schema("a").names == ["x", "y"]
    assert "Scan" in "\n".join(r[0] for r in rows(engine, "EXPLAIN SELECT x FROM a"))


def test_newest_rows(engine):
    engine.execute("CREATE TABLE k (id INTEGER, v TEXT) ENGINE = latest KEY (id); INSERT INTO k VALUES (1, 'old'), (2, 'z'); INSERT INTO k VALUES (1, 'new')")
    engine.execute("CREATE TABLE w (id INTEGER, at INTEGER, v TEXT) ENGINE = latest KEY (id) VERSION (at); INSERT INTO w VALUES (1, 5, 'zz'); INSERT INTO w VALUES (1, 5, 'aa'), (1, 4, 'q')")
    for _ in range(2):
        assert rows(engine, "SELECT id, v FROM k ORDER BY id") == [(1, "new"), (2, "z")] and rows(engine, "SELECT v FROM w") == [("aa",)]
        for t in "kw":
            assert engine.store.compact(t, least=1)
    engine.execute("INSERT INTO k VALUES (2, 'a')")
    assert rows(engine, "SELECT id, v FROM k ORDER BY id") == [(1, "new"), (2, "a")]


def test_deletes_of_decimals(engine):
    engine.execute("CREATE TABLE d (d DECIMAL(38,2), i BIGINT, f DOUBLE); INSERT INTO d VALUES (123456789012345678.91, 1, 1.5), (123456789012345678.92, 2, 2.5)")
    assert engine.execute("DELETE FROM d WHERE d = 123456789012345678.91").count == 1
    assert engine.execute("DELETE FROM d WHERE i < 1.5").count == 0 and engine.execute("DELETE FROM d WHERE f >= 2.6").count == 0
    assert rows(engine, "SELECT i FROM d") == [(2,)] and engine.execute("DELETE FROM d WHERE i > 1.5 AND f = 2.5").count == 1


def test_compaction_merges_neighbours(engine):
    engine.execute("CREATE TABLE a (x INTEGER) ORDER BY (x)")
    for i in range(6):
        engine.execute(f"INSERT INTO a VALUES ({i}), ({-i})")
    paths = [s["path"] for s in engine.store.table("a")["segments"]]
    large = engine.store._bytes(engine.store.table("a")["segments"][0])
    engine.execute("INSERT INTO a SELECT a.x * b.x AS x FROM a JOIN (SELECT x FROM a WHERE x < 0) AS b ON a.x / 100 = b.x / 100")
    v = engine.store.versions()[-1]
    assert engine.store.compact("a", least=3, file_bytes=2 * large) or True
    after = engine.store.table("a")["segments"]
    assert len(after) < 7 and not set(paths) <= {s["path"] for s in after}
    assert sorted(rows(engine, "SELECT x FROM a")) == sorted(rows(engine, f"SELECT x FROM a AT VERSION {v}"))
    assert not engine.store.compact("a", least=9)


def test_backup_opens_as_a_store(engine, spark, tmp_path):
    engine.execute("CREATE TABLE a (x INTEGER); INSERT INTO a VALUES (1), (2); DELETE FROM a WHERE x = 1")
    engine.execute(f"BACKUP TO '{tmp_path}/copy'")
    engine.execute("INSERT INTO a VALUES (3)")
    assert rows(Engine(spark, f"{tmp_path}/copy"), "SELECT x FROM a") == [(2,)]


def test_insert_select_and_many_values(engine):
    engine.execute('CREATE TABLE a (x INTEGER, "x::string" TEXT, y TEXT)')
    engine.execute("INSERT INTO a (x, y) VALUES " + ", ".join(f"({i}, 'r{i}')" for i in range(300)) + ", ('no', NULL), (NULL, 'n')")
    assert rows(engine, 'SELECT count(*) AS n, sum(x) AS s, max(x::string) AS t FROM a') == [(302, 44850, "no")]
    engine.execute("CREATE TABLE b (x BIGINT, y TEXT); INSERT INTO b (y, x) SELECT y, x * 2 AS x FROM a WHERE x > 297")
    assert sorted(rows(engine, "SELECT x, y FROM b")) == [(596, "r298"), (598, "r299")]


def test_the_session_keeps_its_setting(spark, engine):
    assert spark.conf.get("spark.sql.caseSensitive") == "false"
    engine.execute('CREATE TABLE c ("A" INTEGER, a INTEGER); INSERT INTO c VALUES (1, 2)')
    assert rows(engine, 'SELECT "A" AS x, a AS y FROM c') == [(1, 2)] and spark.conf.get("spark.sql.caseSensitive") == "false"


def test_trace_keeps_orphans(spark):
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    data = [("t", "a", None, at(0), 9 * 10**9), ("t", "b", "a", at(1), 2 * 10**9), ("t", "c", "a", at(3), 5 * 10**9), ("t", "d", "c", at(4), 10**9), ("t", "e", "gone", at(1), 10**9), ("u", "a", None, at(0), 1)]
    spans = spark.createDataFrame(data, "trace_id string, span_id string, parent_span_id string, start_time timestamp, duration_ns long")
    out = {r.span_id: (r.depth, r.self_time // 10**9, r.on_critical_path) for r in analysis.trace(spans, "t").collect()}
    assert out == {"a": (0, 2, True), "b": (1, 2, False), "c": (1, 4, True), "d": (2, 1, True), "e": (0, 1, False)}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("trace_")]


def test_service_graph_and_runs(spark):
    spans = spark.createDataFrame([("t", "1", None, "web", 10, 0), ("t", "2", "1", "db", 4, 1), ("t", "3", "1", "db", 6, 0)], "trace_id string, span_id string, parent_span_id string, `service.name` string, duration_ns long, status_code int")
    assert [tuple(r) for r in analysis.service_graph(spans).collect()] == [("web", "db", 2, 1, 5.0)]
    runs = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 4.0), ("b", "y", 2.0), ("c", "x", 99.0)], "run string, k string, v double")
    out = {r.value: (r.before, r.after, r.contribution) for r in analysis.compare_runs(runs, "run", "a", "b", F.col("v"), ["k"]).collect()}
    assert out == {"x": (1.0, 4.0, 1.0), "y": (2.0, 2.0, 0.0)}


def test_streams(spark, engine, tmp_path):
    schema = "ts timestamp, k string, v long"
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    spark.createDataFrame([(at(1), "a", 1), (at(4), "a", 2), (at(11), "a", 4), (at(59), "b", 8)], schema).coalesce(1).write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).json(f"{tmp_path}/in")
    counts = windows.tumbling(stream, "ts", "10 minutes", "1 minute", ["k"], F.sum("v").alias("s"))
    counts.writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.k, r.s) for r in spark.table("tumbled").collect()) == [("a", 3), ("a", 4), ("b", 8)]
    seen = windows.sessions(spark.read.schema(schema).json(f"{tmp_path}/in"), "ts", "5 minutes", "1 minute", ["k"], F.sum("v").alias("s"))
    assert sorted((r.k, r.s) for r in seen.collect()) == [("a", 3), ("a", 4), ("b", 8)]
    engine.execute("CREATE TABLE f (ts TIMESTAMP, k TEXT, v BIGINT)")
    for _ in range(2):
        windows.feed(stream, engine.store, "f", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert rows(engine, "SELECT count(*) AS n, sum(v) AS s FROM f") == [(4, 15)] and os.path.isdir(f"{tmp_path}/state")
