"""The engine's queries by name, each with the SQL that checks it on the same tables. Both sides name every column alike."""

from __future__ import annotations

import tempfile
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import aggs
from .operators import relational
from .plans import analysis
from .plans.binder import Engine

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Hours between the first and last of each kind of event, with what they hold; the statement's own column is put in.
GAPS = """WITH p AS (SELECT event_type, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '2000-01-03') AS b, count(*) AS n, max(event_id) AS m FROM events WHERE value > 95 GROUP BY 1, 2),
s AS (SELECT event_type, unnest(generate_series(min(b), max(b), INTERVAL '1 hour')) AS b FROM p GROUP BY 1),
f AS (SELECT event_type, b, n, m FROM s LEFT JOIN p USING (event_type, b)) SELECT event_type, b, {} FROM f"""
LINES = """WITH p AS (SELECT event_type, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '2000-01-03') AS b, CAST(count(*) AS DOUBLE) AS n FROM events WHERE value > 95 GROUP BY 1, 2),
s AS (SELECT event_type, unnest(generate_series(min(b), max(b), INTERVAL '1 hour')) AS b FROM p GROUP BY 1)
SELECT s.event_type, s.b, coalesce(p.n, x.n + (z.n - x.n) * (epoch_us(s.b) - epoch_us(x.b)) / (epoch_us(z.b) - epoch_us(x.b))) AS n FROM s LEFT JOIN p ON p.event_type = s.event_type AND p.b = s.b
ASOF JOIN p AS x ON x.event_type = s.event_type AND x.b <= s.b ASOF JOIN p AS z ON z.event_type = s.event_type AND z.b >= s.b"""
#: (name, statement of the dialect, SQL of the oracle; none: the same).
STATEMENTS = [
    ("fill_zero", "SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS b, count(*) AS n FROM events WHERE value > 95 GROUP BY event_type, time_bucket(INTERVAL '1 hour', ts) FILL 0", GAPS.format("coalesce(n, 0) AS n")),
    ("fill_previous", "SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS b, max(event_id) AS n FROM events WHERE value > 95 GROUP BY 1, 2 FILL previous", GAPS.format("last_value(m IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY b) AS n")),
    ("fill_linear", "SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS b, count(*) AS n FROM events WHERE value > 95 GROUP BY 1, 2 FILL linear", LINES),
    ("nearest_join_sql", "SELECT p.event_id, e.event_id AS prior FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') AS p LEFT NEAREST JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type <> 'purchase' GROUP BY user_id, ts) AS e ON p.user_id = e.user_id AND p.ts >= e.ts", "SELECT p.event_id, e.event_id AS prior FROM (SELECT * FROM events WHERE event_type = 'purchase') AS p ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type <> 'purchase' GROUP BY user_id, ts) AS e ON p.user_id = e.user_id AND p.ts >= e.ts"),
    ("nearest_join_nulls", "SELECT c.c_custkey, s.s_suppkey FROM (SELECT c_custkey, c_acctbal AS x, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_nationkey END AS k FROM customer) AS c NEAREST JOIN (SELECT min(s_suppkey) AS s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_acctbal END AS y, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_nationkey END AS k FROM supplier GROUP BY 2, 3) AS s ON c.k = s.k AND c.x >= s.y", "SELECT c.c_custkey, s.s_suppkey FROM (SELECT * FROM (SELECT c_custkey, c_acctbal AS x, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_nationkey END AS k FROM customer) WHERE k IS NOT NULL) AS c ASOF JOIN (SELECT min(s_suppkey) AS s_suppkey, s_acctbal AS y, s_nationkey AS k FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey % 4 <> 0 GROUP BY 2, 3) AS s ON c.k = s.k AND c.x >= s.y"),
    ("list_functions", "SELECT o_custkey, list_filter(list_map(xs, x -> x % 10 * 2), y -> y > 6 AND y <> o_custkey % 10) AS ys FROM (SELECT o_custkey, list(o_orderkey) AS xs FROM orders WHERE o_orderkey < 400 AND o_orderkey % 7 = 0 GROUP BY o_custkey HAVING count(*) = 1) AS l", "SELECT o_custkey, list_filter(list_transform(list(o_orderkey), lambda x: x % 10 * 2), lambda y: y > 6 AND y <> o_custkey % 10) AS ys FROM orders WHERE o_orderkey < 400 AND o_orderkey % 7 = 0 GROUP BY o_custkey HAVING count(*) = 1"),
    ("unnest_list", "SELECT n_regionkey, unnest([n_nationkey, n_nationkey + 100, NULL]) AS x FROM nation", "SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, unnest([CAST(n_nationkey AS BIGINT), n_nationkey + 100, NULL]) AS x FROM nation"),
    ("match_score", "SELECT item_id, CAST(score() * 1000000 AS BIGINT) AS s FROM benchmark WHERE MATCH(text, 'the of') AND item_id > 3", "WITH w AS (SELECT item_id, list_filter(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM benchmark), m AS (SELECT count(*) AS n, avg(len(w)) AS a FROM w), h AS (SELECT item_id, len(w) AS l, word, len(list_filter(w, lambda x: x = word)) AS tf FROM w, (VALUES ('the'), ('of')) AS q(word)), d AS (SELECT word, count(*) AS df FROM h WHERE tf > 0 GROUP BY word) SELECT item_id, CAST(round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))) * 1000000) AS BIGINT) AS s FROM h JOIN d USING (word), m WHERE tf > 0 AND item_id > 3 GROUP BY item_id"),
    ("agg_avg", "SELECT l_returnflag, avg(l_linenumber) AS a, avg(CAST(l_quantity AS DECIMAL(12,2))) AS q, approx_count_distinct(l_linestatus) AS d FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, CAST(sum(l_linenumber) AS DOUBLE) / count(*) AS a, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) / count(*) AS q, count(DISTINCT l_linestatus) AS d FROM lineitem GROUP BY l_returnflag"),
    ("unary_text", "SELECT o_orderkey, -o_custkey AS a, +o_orderkey AS b, - -5 AS c, o_custkey::string AS t FROM orders WHERE -o_custkey < -50", "SELECT o_orderkey, -o_custkey AS a, o_orderkey AS b, CAST(5 AS BIGINT) AS c, CAST(NULL AS VARCHAR) AS t FROM orders WHERE o_custkey > 50"),
    ("windows_sql", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, sum(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s FROM events", "SELECT event_id, row_number() OVER w AS r, lag(event_id) OVER w AS p, CAST(sum(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"),
    ("scan_filter_project", "SELECT p_partkey, p_name, p_size FROM part WHERE p_size BETWEEN 5 AND 20 AND p_name ILIKE '%a%' AND p_brand IN ('Brand#1', 'Brand#11', 'Brand#12', 'Brand#23', 'Brand#3')", "SELECT p_partkey, p_name, CAST(p_size AS BIGINT) AS p_size FROM part WHERE p_size BETWEEN 5 AND 20 AND p_name ILIKE '%a%' AND p_brand IN ('Brand#1', 'Brand#11', 'Brand#12', 'Brand#23', 'Brand#3')"),
    ("like_not", "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT c_mktsegment LIKE 'A%' AND c_acctbal > 100", None),
    ("agg_multi", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS qty, min(l_shipdate) AS a, max(l_shipdate) AS z, count(DISTINCT l_suppkey) AS supps FROM lineitem GROUP BY l_returnflag, l_linestatus", None),
    ("agg_global", "SELECT count(*) AS n, count(l_orderkey) AS k, min(l_partkey) AS lo, max(l_partkey) AS hi, CAST(sum(l_quantity) AS BIGINT) AS qty FROM lineitem WHERE l_quantity > 10", None),
    ("agg_decimal", "SELECT o_orderpriority, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM orders GROUP BY o_orderpriority", None),
    ("agg_empty", "SELECT count(*) AS n, max(o_orderkey) AS m FROM orders WHERE o_orderkey < 0", None),
    ("having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 8", None),
    ("filter_clause", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS big, max(user_id) FILTER (WHERE value <= 50) AS u FROM events GROUP BY event_type", None),
    ("distinct_count", "SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS kinds FROM events", None),
    ("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", None),
    ("group_expr", "SELECT CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, date_trunc('month', o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1, m", "SELECT CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, date_trunc('month', o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1, 2"),
    ("join_inner", "SELECT c_mktsegment, count(*) AS n, max(o_orderkey) AS k FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c_mktsegment", None),
    ("join_left", "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderpriority = '1-URGENT' GROUP BY c.c_custkey", None),
    ("join_three", "SELECT r_name, n_name, count(*) AS n FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r_name, n_name", None),
    ("join_residual", "SELECT count(*) AS n FROM customer c JOIN supplier s ON c.c_nationkey = s.s_nationkey AND c.c_acctbal > s.s_acctbal", None),
    ("union_all", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region", None),
    ("cte", "WITH big AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_totalprice > 150000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT n, count(*) AS customers FROM per GROUP BY n", None),
    ("subquery_from", "SELECT s.seg, s.n FROM (SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY c_mktsegment) AS s WHERE s.n > 1", None),
    ("topk_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5", None),
    ("order_nulls", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 250000 ORDER BY o.o_orderkey DESC, c.c_custkey LIMIT 40", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 250000 ORDER BY o.o_orderkey DESC NULLS FIRST, c.c_custkey LIMIT 40"),
    ("time_bucket", "SELECT time_bucket(INTERVAL '6 hours', ts) AS bucket, event_type, count(*) AS n FROM events GROUP BY bucket, event_type", "SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2000-01-03') AS bucket, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    ("date_parts", "SELECT event_id, extract(year FROM ts) AS y, extract(dow FROM ts) AS dow, extract(week FROM ts) AS w, extract(doy FROM ts) AS doy, extract(hour FROM ts) AS h, extract(second FROM ts) AS s, extract(millisecond FROM ts) AS ms, extract(quarter FROM ts) AS qu FROM events", None),
    ("date_trunc", "SELECT date_trunc('week', ts) AS w, count(*) AS n FROM events GROUP BY 1", None),
    ("strings", "SELECT c_custkey, upper(c_name) AS u, length(c_name) AS n, substr(c_name, 3, 5) AS s, lower(c_mktsegment) || '!' AS m FROM customer", None),
    ("regex", "SELECT p_partkey FROM part WHERE regexp_matches(p_type, '^[A-M].*(TIN|COPPER|STEEL)$') OR regexp_matches(p_name, 'o{1,2}\\w')", None),
    ("cast_case", "SELECT p_partkey, CAST(p_size AS TEXT) AS t, CAST(p_size AS DOUBLE) AS d, CAST(p_retailprice AS DECIMAL(12,2)) AS dec FROM part", None),
    ("int_division", "SELECT o_orderkey, o_orderkey / 7 AS a, o_orderkey % 7 AS b, o_custkey / (o_custkey % 3) AS c, o_custkey % (o_custkey % 3) AS d FROM orders", "SELECT o_orderkey, o_orderkey // 7 AS a, o_orderkey % 7 AS b, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey // (o_custkey % 3) END AS c, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey % (o_custkey % 3) END AS d FROM orders"),
    ("decimal_arithmetic", "SELECT p_partkey, CAST(p_retailprice AS DECIMAL(10,2)) * 1.5 AS m, CAST(p_retailprice AS DECIMAL(10,2)) + p_size AS s FROM part", "SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(10,2)) * 1.5 AS DECIMAL(12,3)) AS m, CAST(CAST(p_retailprice AS DECIMAL(10,2)) + p_size AS DECIMAL(22,2)) AS s FROM part"),
    ("null_logic", "SELECT count(*) AS n, count(*) FILTER (WHERE (o.o_orderkey > 10) IS NOT TRUE) AS a, count(*) FILTER (WHERE o.o_orderkey IS NULL) AS b FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderpriority = '2-HIGH'", None),
    ("quantile", "SELECT l_returnflag, quantile(l_quantity, 0.95) AS q95, quantile(l_partkey, 0.5) AS med FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, list_sort(list(l_quantity))[CAST(floor(0.95 * (count(l_quantity) - 1)) AS BIGINT) + 1] AS q95, list_sort(list(l_partkey))[CAST(floor(0.5 * (count(l_partkey) - 1)) AS BIGINT) + 1] AS med FROM lineitem GROUP BY l_returnflag"),
    ("histogram", "SELECT l_linestatus, histogram(l_returnflag) AS h FROM lineitem GROUP BY l_linestatus", "SELECT l_linestatus, '{' || string_agg(l_returnflag || '=' || n, ', ' ORDER BY l_returnflag) || '}' AS h FROM (SELECT l_linestatus, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1"),
    ("top_k", "SELECT event_type, top_k(user_id, 3) AS k FROM events GROUP BY event_type", "SELECT event_type, list(user_id ORDER BY r) AS k FROM (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id) AS r FROM events GROUP BY event_type, user_id) WHERE r <= 3 GROUP BY event_type"),
    ("arg_max", "SELECT l_returnflag, arg_max(l_orderkey, l_orderkey * 10 + l_linenumber) AS k, min_by(l_partkey, l_orderkey * 10 + l_linenumber) AS p FROM lineitem GROUP BY l_returnflag", None),
    ("approx_quantile", "SELECT l_linestatus, approx_quantile(l_quantity, 0.5) AS m FROM lineitem GROUP BY l_linestatus", "WITH b AS (SELECT l_linestatus, ceil(ln(l_quantity) / ln(1.01::DOUBLE / 0.99::DOUBLE)) AS k, count(*) AS n FROM lineitem GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER (PARTITION BY l_linestatus ORDER BY k) AS u, sum(n) OVER (PARTITION BY l_linestatus) AS t FROM b) SELECT l_linestatus, 2 * pow(1.01::DOUBLE / 0.99::DOUBLE, min(k)) / (1.01::DOUBLE / 0.99::DOUBLE + 1) AS m FROM c WHERE u > 0.5 * (t - 1) GROUP BY 1"),
    ("limit_per", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 2 PER o_custkey", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2"),
    ("group_all_exclude", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM (SELECT * EXCLUDE (o_totalprice) FROM orders) AS o GROUP BY ALL", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL"),
    ("log_search", "SELECT conv_id, turn FROM conversations WHERE text ILIKE '%the%' AND role = 'user'", None),
    ("error_rate", "SELECT event_type, count(*) FILTER (WHERE value > 90) * 100 / count(*) AS pct FROM events GROUP BY event_type", "SELECT event_type, count(*) FILTER (WHERE value > 90) * 100 // count(*) AS pct FROM events GROUP BY event_type"),
]


def statement(sql: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark)
    for t in TABLES:
        if f" {t}" in sql or f"({t}" in sql:
            engine.register(t, spark.read.parquet(f"{sf_dir}/{t}.parquet"))
    return engine.sql(sql)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statement("SELECT l_suppkey, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS qty, count(DISTINCT l_partkey) AS parts FROM lineitem WHERE l_quantity > 5 GROUP BY l_suppkey ORDER BY n DESC, l_suppkey LIMIT 10", spark, sf_dir)


def nearest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.filter("event_type <> 'purchase'").groupBy("user_id", F.col("ts").alias("at")).agg(F.max("event_id").alias("prior_id"))
    return relational.nearest_join(left, right, ["user_id"], "ts", "at", ["prior_id"])


def gap_fill(spark: SparkSession, sf_dir: str, fill: str = "zero") -> DataFrame:
    e = read(spark, sf_dir, "events")
    day = 86400 * 10**6
    per = relational.bucketed(e, "ts", day, ["event_type"], F.count(F.when(F.col("value") > 80, 1)).alias("n"))
    return relational.gap_filled(per.filter("n > 0"), "bucket", day, "n", ["event_type"], fill)


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.latest(read(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.profile(read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")).select("column", "present", "least", "most", "rows")


def elucidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    year = F.year("o_orderdate")
    return analysis.elucidate(o, F.lit(1), year % 2 == 0, year % 2 == 1, ["o_orderstatus", "o_orderpriority"]).select("column", "value", "before", "after", "support")


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.patterns(read(spark, sf_dir, "customer"), F.col("c_name")).select("template", "n")


def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "benchmark")
    return analysis.matched(c, "item_id", F.col("text"), "the of").select("key", F.round("score", 6).alias("score"))


def list_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(aggs.list_agg(F.col("n_name"))).alias("names"))


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    first = e.orderBy("vec_id").select("embedding").first()[0]
    return relational.nearest_vectors(e, "embedding", list(first), 10, "vec_id").select("vec_id", F.round("score", 5).alias("score"))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select("event_id", F.row_number().over(w).cast("long").alias("r"), F.lag("event_id").over(w).alias("before"), F.lead("event_id").over(w).alias("after"), F.count(F.lit(1)).over(w.rowsBetween(-2, 0)).alias("near"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark).sql(f"FROM '{sf_dir}/natio*.parquet' AS n SELECT n_regionkey, count(*) AS n, max(n_name) AS last GROUP BY n_regionkey")


def folder_of(spark: SparkSession) -> str:
    """A new folder for a store of a query: below the session's checkpoint folder, where there is one."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", "").removeprefix("file://")
    return tempfile.mkdtemp(prefix="store-", dir=shared or None)


def store_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row of a key without VERSION, and of ties of it: what was written last."""
    e = Engine(spark, folder_of(spark))
    e.register("events", read(spark, sf_dir, "events"))
    for name, version in (("plain", ""), ("tied", " VERSION (v)")):
        e.execute(f"CREATE TABLE {name} (u BIGINT, v BIGINT, e BIGINT) ENGINE = latest KEY (u){version}")
        for i in range(3):
            e.execute(f"INSERT INTO {name} SELECT user_id, 1 AS v, max(event_id) AS e FROM events WHERE event_id % 3 = {(i + 1) % 3} GROUP BY user_id")
    return e.sql("SELECT p.u, p.e AS plain, t.e AS tied FROM plain AS p JOIN tied AS t ON p.u = t.u")


def store_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletes that compare decimals, which no double holds."""
    e = Engine(spark, folder_of(spark))
    e.register("orders", read(spark, sf_dir, "orders"))
    e.execute("CREATE TABLE o (k BIGINT, d DECIMAL(38,4))")
    e.execute("INSERT INTO o SELECT o_orderkey, 123456789012345678.91 + o_orderkey * 0.0001 AS d FROM orders")
    e.execute("DELETE FROM o WHERE d <= 123456789012345678.9200; DELETE FROM o WHERE d = 123456789012345678.9303")
    return e.sql("SELECT count(*) AS n, min(k) AS lo, count(*) FILTER (WHERE k = 203) AS gone FROM o")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as spans: an order is a trace, its lines a tree in which line n hangs on line n / 2; line 5's parent isn't there."""
    line = F.col("l_linenumber").cast("long")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("trace_id"), line.cast("string").alias("span_id"),
        F.when(line == 5, "lost").when(line > 1, F.floor(line / 2).cast("string")).alias("parent_span_id"), F.col("l_returnflag").alias("service.name"),
        F.col("l_shipdate").alias("start_time"), F.col("l_quantity").cast("long").alias("duration_ns"), (line % 3).alias("status_code"),
    )


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = spans(spark, sf_dir).groupBy("trace_id", "span_id", "parent_span_id").agg(F.max("start_time").alias("start_time"), F.max("duration_ns").alias("duration_ns"))
    return analysis.trace(once, "7").select("span_id", F.col("depth").cast("long").alias("depth"), "self_time", "on_critical_path")


def service_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.service_graph(spans(spark, sf_dir)).select("caller", "callee", "calls", "errors")


def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").withColumn("price", F.round(F.col("o_totalprice")))
    out = analysis.compare_runs(o, "o_orderstatus", "F", "O", F.col("price"), ["o_orderpriority"])
    return out.select("column", "value", "before", "after", *[F.round(c, 6).alias(c) for c in ("contribution", "mix", "rate")], "support")


def profile_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = analysis.profile(read(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", "o_custkey"))
    return out.select("column", "type", "present", "presence", "least", "most", "rows", F.array_join("top_values", ",").alias("top_values"))


FUNCTIONS = {
    files: "SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, count(*) AS n, max(n_name) AS last FROM nation GROUP BY 1",
    store_latest: "SELECT user_id AS u, coalesce(max(event_id) FILTER (WHERE event_id % 3 = 0), max(event_id) FILTER (WHERE event_id % 3 = 2), max(event_id)) AS plain, coalesce(max(event_id) FILTER (WHERE event_id % 3 = 0), max(event_id) FILTER (WHERE event_id % 3 = 2), max(event_id)) AS tied FROM events GROUP BY user_id",
    store_delete: "SELECT count(*) AS n, min(o_orderkey) AS lo, count(*) FILTER (WHERE o_orderkey = 203) AS gone FROM orders WHERE o_orderkey > 100 AND o_orderkey <> 203",
    trace: "WITH RECURSIVE s AS (SELECT l_linenumber AS id, CASE WHEN l_linenumber IN (1, 5) THEN NULL ELSE l_linenumber // 2 END AS up, epoch_us(max(l_shipdate)) * 1000 + max(CAST(l_quantity AS BIGINT)) AS e, max(CAST(l_quantity AS BIGINT)) AS d FROM lineitem WHERE l_orderkey = 7 GROUP BY l_linenumber), f AS (SELECT id, d, CASE WHEN up IN (SELECT id FROM s) THEN up END AS up, e FROM s), l AS (SELECT *, row_number() OVER (PARTITION BY up ORDER BY e DESC, CAST(id AS VARCHAR)) = 1 AS last FROM f), t AS (SELECT id, 0 AS depth, last AS crit FROM l WHERE up IS NULL UNION ALL SELECT l.id, t.depth + 1, t.crit AND l.last FROM l JOIN t ON l.up = t.id) SELECT CAST(t.id AS VARCHAR) AS span_id, CAST(depth AS BIGINT) AS depth, greatest(f.d - coalesce((SELECT sum(c.d) FROM f AS c WHERE c.up = t.id), 0), 0)::BIGINT AS self_time, crit AS on_critical_path FROM t JOIN f ON f.id = t.id",
    service_graph: "SELECT a.l_returnflag AS caller, b.l_returnflag AS callee, count(*) AS calls, count(*) FILTER (WHERE b.l_linenumber % 3 = 1) AS errors FROM lineitem AS a JOIN lineitem AS b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber > 1 AND b.l_linenumber <> 5 AND a.l_linenumber = b.l_linenumber // 2 GROUP BY 1, 2",
    compare_runs: "WITH g AS (SELECT o_orderpriority AS value, coalesce(sum(round(o_totalprice)) FILTER (WHERE o_orderstatus = 'F'), 0) AS b, coalesce(sum(round(o_totalprice)) FILTER (WHERE o_orderstatus = 'O'), 0) AS a, count(*) FILTER (WHERE o_orderstatus = 'F') AS n0, count(*) FILTER (WHERE o_orderstatus = 'O') AS n1 FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1) SELECT 'o_orderpriority' AS \"column\", value, b AS before, a AS after, round((a - b) / sum(a - b) OVER (), 6) AS contribution, round((n1 - n0) * (b / greatest(n0, 1)), 6) AS mix, round((a / greatest(n1, 1) - b / greatest(n0, 1)) * n1, 6) AS rate, n0 + n1 AS support FROM g",
    profile_orders: "WITH v AS (SELECT 'o_orderstatus' AS c, 'string' AS t, o_orderstatus AS v FROM orders UNION ALL SELECT 'o_orderpriority', 'string', o_orderpriority FROM orders UNION ALL SELECT 'o_custkey', 'bigint', CAST(o_custkey AS VARCHAR) FROM orders), n AS (SELECT c, v, count(*) AS n, row_number() OVER (PARTITION BY c ORDER BY count(*) DESC, v) AS r FROM v WHERE v IS NOT NULL GROUP BY c, v) SELECT c AS \"column\", any_value(t) AS type, count(v) AS present, count(v) / count(*) AS presence, CASE WHEN c = 'o_custkey' THEN CAST(min(TRY_CAST(v AS BIGINT)) AS VARCHAR) ELSE min(v) END AS least, CASE WHEN c = 'o_custkey' THEN CAST(max(TRY_CAST(v AS BIGINT)) AS VARCHAR) ELSE max(v) END AS most, count(*) AS \"rows\", (SELECT string_agg(n.v, ',' ORDER BY r) FROM n WHERE n.c = v.c AND r <= 5) AS top_values FROM v GROUP BY c",
    flagship: "SELECT l_suppkey, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS qty, count(DISTINCT l_partkey) AS parts FROM lineitem WHERE l_quantity > 5 GROUP BY l_suppkey ORDER BY n DESC, l_suppkey LIMIT 10",
    nearest_join: "SELECT p.event_id, p.user_id, p.ts, arg_max(e.prior_id, e.at) AS prior_id FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') p LEFT JOIN (SELECT user_id, ts AS at, max(event_id) AS prior_id FROM events WHERE event_type <> 'purchase' GROUP BY 1, 2) e ON e.user_id = p.user_id AND e.at <= p.ts GROUP BY 1, 2, 3",
    gap_fill: "WITH p AS (SELECT event_type, time_bucket(INTERVAL '1 day', ts, TIMESTAMP '2000-01-03') AS bucket, count(*) AS n FROM events WHERE value > 80 GROUP BY 1, 2), s AS (SELECT event_type, unnest(generate_series(min(bucket), max(bucket), INTERVAL '1 day')) AS bucket FROM p GROUP BY 1) SELECT s.event_type, s.bucket, coalesce(p.n, 0) AS n FROM s LEFT JOIN p USING (event_type, bucket)",
    latest: "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
    profile: "SELECT 'n_nationkey' AS \"column\", count(n_nationkey) AS present, CAST(min(n_nationkey) AS VARCHAR) AS least, CAST(max(n_nationkey) AS VARCHAR) AS most, count(*) AS \"rows\" FROM nation UNION ALL SELECT 'n_name', count(n_name), min(n_name), max(n_name), count(*) FROM nation UNION ALL SELECT 'n_regionkey', count(n_regionkey), CAST(min(n_regionkey) AS VARCHAR), CAST(max(n_regionkey) AS VARCHAR), count(*) FROM nation",
    elucidate: "SELECT \"column\", value, CAST(count(*) FILTER (WHERE y % 2 = 0) AS DOUBLE) AS before, CAST(count(*) FILTER (WHERE y % 2 = 1) AS DOUBLE) AS after, count(*) AS support FROM (SELECT 'o_orderstatus' AS \"column\", o_orderstatus AS value, year(o_orderdate) AS y FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority, year(o_orderdate) FROM orders) GROUP BY 1, 2",
    patterns: "SELECT regexp_replace(c_name, '[-+]?\\d+(\\.\\d+)?', '<num>', 'g') AS template, count(*) AS n FROM customer GROUP BY 1",
    bm25: "WITH w AS (SELECT item_id AS key, list_filter(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM benchmark), m AS (SELECT count(*) AS n, avg(len(w)) AS a FROM w), h AS (SELECT key, l, word, count(*) AS tf FROM (SELECT key, len(w) AS l, unnest(w) AS word FROM w) WHERE word IN ('the', 'of') GROUP BY 1, 2, 3), d AS (SELECT word, count(*) AS df FROM h GROUP BY 1) SELECT key, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))), 6) AS score FROM h JOIN d USING (word), m GROUP BY key",
    list_agg: "SELECT n_regionkey, list_sort(list(n_name)) AS names FROM nation GROUP BY n_regionkey",
    nearest_vectors: "WITH f AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 5) AS score FROM embeddings, f ORDER BY list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) DESC, vec_id LIMIT 10",
    windows: "SELECT event_id, row_number() OVER w AS r, lag(event_id) OVER w AS before, lead(event_id) OVER w AS after, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS near FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
}


def queries() -> dict:
    return {f.__name__: f for f in FUNCTIONS} | {name: partial(statement, sql) for name, sql, _ in STATEMENTS}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: sql for f, sql in FUNCTIONS.items()} | {name: oracle or sql for name, sql, oracle in STATEMENTS}
