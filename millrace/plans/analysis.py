"""What changed, what a table holds, and how traces and logs look: analyses made of plain plans."""

from __future__ import annotations

import math
import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.ingest import q


def profile(df: DataFrame) -> DataFrame:
    """A row for each column: type, presence, cardinality, least, most, and the most frequent values. One pass, then one of counts."""
    parts = []
    for c in df.columns:
        x = F.col(q(c))
        parts += [F.count(x), F.approx_count_distinct(x), F.min(x).cast("string"), F.max(x).cast("string")]
    wide = df.agg(F.count(F.lit(1)).alias("rows"), *[p.alias(f"m{i}") for i, p in enumerate(parts)])
    lines = [F.struct(F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("type"), *[F.col(f"m{4 * i + j}").alias(n) for j, n in enumerate(("present", "distinct", "least", "most"))], "rows") for i, c in enumerate(df.columns)]
    stats = wide.select(F.explode(F.array(*lines)).alias("x")).select("x.*").withColumn("presence", F.col("present") / F.col("rows"))
    values = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(q(c)).cast("string").alias("v")) for c in df.columns])).alias("x")).select("x.*")
    best = values.filter("v is not null").groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "v"))).filter("r <= 5").groupBy("column").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "v"))), lambda s: s["v"]).alias("top_values"))
    return stats.join(best, "column", "left")


def elucidate(df: DataFrame, metric: Column, baseline: Column, target: Column, by: list[str], least_support: int = 1) -> DataFrame:
    """How each value of the columns `by` adds to the change of sum(metric) between two windows: rows (finding by contribution).

    contribution: its share of the change; mix: what its number of rows explains; rate: what its mean explains."""
    which = F.when(baseline, 0).when(target, 1)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(q(c)).cast("string").alias("value")) for c in by])
    rows = df.select(which.alias("w"), metric.cast("double").alias("m"), pairs.alias("p")).filter("w is not null")
    part = lambda w: F.coalesce(F.sum(F.when(F.col("w") == w, F.col("m"))), F.lit(0.0))
    n = lambda w: F.count(F.when(F.col("w") == w, 1))
    each = rows.select("w", "m", F.explode("p").alias("x")).groupBy("x.column", "x.value").agg(part(0).alias("before"), part(1).alias("after"), n(0).alias("n0"), n(1).alias("n1"))
    change, both = F.col("after") - F.col("before"), Window.partitionBy("column")
    total = F.sum(change).over(both)
    r0, r1 = F.col("before") / F.greatest("n0", F.lit(1)), F.col("after") / F.greatest("n1", F.lit(1))
    out = each.select("column", "value", "before", "after", F.when(total != 0, change / total).alias("contribution"), ((F.col("n1") - F.col("n0")) * r0).alias("mix"), ((r1 - r0) * F.col("n1")).alias("rate"), (F.col("n0") + F.col("n1")).alias("support"))
    return out.filter(F.col("support") >= least_support).orderBy(F.abs(F.col("after") - F.col("before")).desc(), "column", "value")


def compare_runs(df: DataFrame, run: str, a: str, b: str, metric: Column, by: list[str]) -> DataFrame:
    return elucidate(df, metric, F.col(q(run)) == a, F.col(q(run)) == b, by)


def patterns(df: DataFrame, text: Column) -> DataFrame:
    """Templates of messages: ids, numbers, addresses and quoted parts give way to marks; (template, n, example)."""
    masks = [(r"[0-9a-fA-F]{8}-[0-9a-fA-F-]{27}", "<id>"), (r"\b\d+\.\d+\.\d+\.\d+(:\d+)?\b", "<ip>"), (r"\b0x[0-9a-fA-F]+\b|\b[0-9a-f]{16,}\b", "<hex>"), (r'"[^"]*"', "<text>"), (r"[-+]?\d+(\.\d+)?", "<num>")]
    template = reduce(lambda x, m: F.regexp_replace(x, m[0], m[1]), masks, text)
    return df.select(template.alias("template"), text.alias("t")).groupBy("template").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("example"))


def trace(spans: DataFrame, trace_id: str, id_: str = "span_id", parent: str = "parent_span_id", start: str = "start_time", duration: str = "duration_ns") -> DataFrame:
    """A trace's spans with depth, self_time (without its children's), ends_last (of its siblings) and on_critical_path: from the
    root that ends last on, each time to the child that does. A span whose parent isn't there is a root. One trace is small."""
    rows = spans.filter(F.col("trace_id") == trace_id)
    end = F.unix_micros(F.col(q(start)).cast("timestamp")) * 1000 + F.col(q(duration))
    there = rows.select(F.col(q(id_)).alias("there")).distinct()
    links = rows.select(F.col(q(id_)).alias("id"), F.col(q(parent)).alias("of"), end.alias("end")).join(there, F.col("of") == F.col("there"), "left")
    # a span that was sent again is one span, as it ended last
    links = links.groupBy("id").agg(F.max(F.struct("end", F.col("there").alias("of"))).alias("x")).select("id", "x.of", "x.end")
    last = F.row_number().over(Window.partitionBy("of").orderBy(F.col("end").desc(), "id")) == 1
    view = f"trace_{uuid.uuid4().hex}"
    links.select("id", "of", last.alias("ends_last")).createOrReplaceTempView(view)
    try:
        tree = rows.sparkSession.sql(f"""WITH RECURSIVE t(id, depth, critical) AS (SELECT id, 0, ends_last FROM {view} WHERE of IS NULL
            UNION ALL SELECT s.id, t.depth + 1, t.critical AND s.ends_last FROM {view} s JOIN t ON s.of = t.id)
            SELECT t.id, depth, critical, ends_last FROM t JOIN {view} v ON t.id = v.id""")
    finally:
        rows.sparkSession.catalog.dropTempView(view)
    child = rows.groupBy(F.col(q(parent)).alias("of")).agg(F.sum(q(duration)).alias("inside"))
    out = rows.join(tree, rows[q(id_)] == tree["id"]).join(child, rows[q(id_)] == child["of"], "left")
    own = F.greatest(F.col(q(duration)) - F.coalesce("inside", F.lit(0)), F.lit(0))
    return out.select(*[rows[q(c)] for c in rows.columns], "depth", own.alias("self_time"), "ends_last", F.col("critical").alias("on_critical_path"))


def service_graph(spans: DataFrame, service: str = "service.name") -> DataFrame:
    """(caller, callee, calls, errors, mean duration)."""
    up = spans.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col(q(service)).alias("caller"))
    return spans.join(up, ["trace_id", "parent_span_id"]).groupBy("caller", F.col(q(service)).alias("callee")).agg(F.count(F.lit(1)).alias("calls"), F.sum((F.col("status_code") == 1).cast("long")).alias("errors"), F.avg("duration_ns").alias("mean_ns"))


def terms_of(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def bm25(df: DataFrame, text: Column, query: str, k1: float = 1.2, b: float = 0.75) -> tuple[Column, Column]:
    """(score, whether a word of the query is there) of the rows of `df`. One pass over it counts its rows, words and holders."""
    words = sorted(set(re.findall(r"[^\W_]+", query.lower())))
    terms = F.coalesce(terms_of(text), F.array().cast("array<string>"))
    times = lambda w: F.size(F.filter(terms, lambda t: t == w))
    n, mean, *holders = df.agg(F.count(text), F.avg(F.when(text.isNotNull(), F.size(terms))), *[F.count(F.when(times(w) > 0, 1)) for w in words]).first()
    score = F.lit(0.0)
    for w, h in zip(words, holders):
        idf = math.log(1 + (n - h + 0.5) / (h + 0.5))
        score = score + idf * times(w) * (k1 + 1) / (times(w) + k1 * (1 - b + b * F.size(terms) / F.lit(float(mean or 1))))
    return score, F.arrays_overlap(terms, F.array(*map(F.lit, words)).cast("array<string>"))


def matched(df: DataFrame, key: str, text: Column, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) by BM25 of the rows that hold a word of the query."""
    score, hit = bm25(df, text, query, k1, b)
    return df.filter(hit).select(F.col(q(key)).alias("key"), score.alias("score"))
