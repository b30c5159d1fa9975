"""SQL for what the contracts of the text queries fix exactly.

Where a whole result is fixed, the query itself has its SQL; else a query exactN_<name> has the part of opN's rows that is.
Every statement reads the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words by ASCII white space, of the text t.
WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"

OP4 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM d)),
hit AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS f FROM w) WHERE f < doc_id),
gone AS (SELECT DISTINCT doc_id, p + k AS b FROM hit CROSS JOIN range(50) AS r(k)),
runs AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE last IS NULL OR last < b - 1) AS n_spans
  FROM (SELECT doc_id, b, lag(b) OVER (PARTITION BY doc_id ORDER BY b) AS last FROM gone) GROUP BY doc_id),
places AS (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS b FROM d WHERE doc_id IN (SELECT doc_id FROM gone)),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * b + 1, 2), '' ORDER BY b) AS h FROM places ANTI JOIN gone USING (doc_id, b) GROUP BY doc_id)
SELECT doc_id, length(d.h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  CASE WHEN n_removed IS NULL THEN sha256(t) ELSE sha256(unhex(coalesce(kept.h, ''))) END AS kept_sha256
FROM d LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP9 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, {WORDS} AS w FROM d),
base AS (SELECT d.r, doc_id, source, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d JOIN w USING (r)),
windows AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, a, b, c) > 1),
again AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
line AS (SELECT r, source, trim(l, ' ') AS l FROM (SELECT r, source, unnest(string_split(
  regexp_replace(regexp_replace(lower(text), '[0-9]+', '0', 'g'), '[ \t\x0b\f\r]+', ' ', 'g'), chr(10))) AS l FROM d WHERE text IS NOT NULL)),
hosts AS (SELECT source, count(*) AS size FROM d WHERE text IS NOT NULL GROUP BY source),
often AS (SELECT line.source, l FROM line JOIN hosts ON line.source IS NOT DISTINCT FROM hosts.source WHERE l <> ''
  GROUP BY line.source, l, size HAVING count(DISTINCT r) > 20 AND count(DISTINCT r) > 0.02 * size),
lost AS (SELECT r, sum(length(line.l) - length(replace(line.l, ' ', '')) + 1) AS lost FROM line
  JOIN often ON line.source IS NOT DISTINCT FROM often.source AND line.l = often.l GROUP BY r),
all_ AS (SELECT *, least(coalesce(lost, 0), n_words) AS gone, coalesce(n_repeat_words, 0) AS again_,
  n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed FROM base LEFT JOIN again USING (r) LEFT JOIN lost USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, again_ AS n_repeat_words, base_failed,
  CASE WHEN n_words > 0 THEN 1 - CAST(gone AS DOUBLE) / n_words ELSE 0.0 END AS kept_share,
  NOT base_failed AND CASE WHEN n_words > 0 THEN 1 - CAST(gone AS DOUBLE) / n_words ELSE 0.0 END >= 0.3 AND n_words - gone >= 50 AS kept
FROM all_
"""

EXACT1 = """
SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, 'rows' AS law FROM documents
"""

EXACT1_SHARDS = """
SELECT CAST(s AS INTEGER) AS shard, (n * (s + 1) + 15) // 16 - (n * s + 15) // 16 AS n, 0 AS lo, (n * (s + 1) + 15) // 16 - (n * s + 15) // 16 - 1 AS hi,
  (n * (s + 1) + 15) // 16 - (n * s + 15) // 16 AS slots
FROM (SELECT count(*) AS n FROM documents) CROSS JOIN range(16) AS r(s)
"""

EXACT2 = r"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM u)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS ruled FROM r
"""

EXACT3 = r"SELECT doc_id, NOT regexp_matches(coalesce(text, ''), '\pL') AS no_letter FROM documents"

EXACT5 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first_value(coalesce(text, '')) OVER (ORDER BY doc_id)) AS nxt FROM documents),
e AS (SELECT doc_id, 0 AS kind, t FROM d UNION ALL SELECT doc_id, 1, substr(t, 1, length(t) - length(t) // 2) || substr(nxt, 1, length(t) // 2) FROM d
  UNION ALL SELECT doc_id, 2, nxt FROM d),
w AS (SELECT doc_id, kind, t, {WORDS} AS w FROM e),
s AS (SELECT doc_id, kind, t, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM w),
x AS (SELECT a.doc_id, a.t, a.s AS s0, b.t AS edited, b.s AS s1, c.s AS s2 FROM s AS a JOIN s AS b ON a.doc_id = b.doc_id AND b.kind = 1
  JOIN s AS c ON a.doc_id = c.doc_id AND c.kind = 2 WHERE a.kind = 0)
SELECT doc_id, length(t) AS n_chars, sha256(edited) AS edited_sha256,
  CASE WHEN len(s0) = 0 AND len(s1) = 0 THEN 1.0::DOUBLE WHEN len(s0) = 0 OR len(s1) = 0 THEN 0.0::DOUBLE
    ELSE greatest(len(list_intersect(s0, s1))::DOUBLE / len(s0), len(list_intersect(s0, s1))::DOUBLE / len(s1)) END AS near_edited,
  CASE WHEN len(s0) = 0 AND len(s2) = 0 THEN 1.0::DOUBLE WHEN len(s0) = 0 OR len(s2) = 0 THEN 0.0::DOUBLE
    ELSE greatest(len(list_intersect(s0, s2))::DOUBLE / len(s0), len(list_intersect(s0, s2))::DOUBLE / len(s2)) END AS near_next
FROM x
"""


def _exact6() -> str:
    from . import secrets

    parts = []
    for rank, (kind, pattern, least, group, chars) in enumerate(secrets.FORMS):
        quoted = pattern.replace("'", "''")
        parts.append(f"""
SELECT r, {rank} AS rank, '{kind}' AS kind, start, start + length(m[i]) AS end_ FROM (
  SELECT r, m, g, i, coalesce(list_sum(list_transform(p[1 : i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT r, regexp_extract_all(t, '{quoted}') AS m, regexp_extract_all(t, '{quoted}', {group}) AS g,
    string_split_regex(t, '{quoted}') AS p FROM d)))
WHERE length(m[i]) >= {least} AND length(g[i]) >= {chars}""")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), s AS ({" UNION ALL ".join(parts)}),
n AS (SELECT r, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  string_agg(kind || ':' || CAST(CAST(start AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(end_ AS BIGINT) AS VARCHAR), ',' ORDER BY start, rank) AS spans FROM s GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256
FROM d LEFT JOIN n USING (r)
"""


EXACT7 = "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents"

EXACT8 = """
SELECT count(*) AS documents, 0 AS too_long, 0 AS gaps, 0 AS cut_early, 0 AS cut_short FROM documents
"""

EXACT10 = """
SELECT doc_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS copies, 1 AS classes_of_copies, true AS id_is_least FROM documents
"""


def exact8(packed: DataFrame) -> DataFrame:
    """Sequences over 4096 tokens; places that don't follow each other; pieces that aren't full though another follows, or cut from a
    document that fits."""
    sequences = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.min("offset").alias("start"))
    whole = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("length").alias("n"), F.sum((F.col("length") == 4096).cast("long")).alias("full"))
    docs = whole.agg(
        F.count(F.lit(1)).alias("documents"), F.sum((F.col("pieces") - F.col("full") > 1).cast("long")).alias("cut_early"),
        F.sum(((F.col("pieces") > 1) & (F.col("n") <= 4096)).cast("long")).alias("cut_short"),
    )
    rooms = sequences.agg(F.sum((F.col("n") > 4096).cast("long")).alias("too_long"), F.sum(((F.col("end") != F.col("n")) | (F.col("start") != 0)).cast("long")).alias("gaps"))
    return docs.join(rooms).select("documents", "too_long", "gaps", "cut_early", "cut_short")  # one row each


def exact10(classed: DataFrame, texts: DataFrame) -> DataFrame:
    """By document: its copies, how many classes they are in, and whether its class is named by its smallest member."""
    named = texts.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("m"))
    both = classed.join(named, "doc_id")
    copies = both.groupBy("h", "m").agg(F.count(F.lit(1)).alias("copies"), F.countDistinct("class_id").alias("classes_of_copies"))
    least = classed.groupBy("class_id").agg((F.min("doc_id") == F.col("class_id")).alias("id_is_least"))
    return both.join(copies, ["h", "m"]).join(least, "class_id").select("doc_id", "copies", "classes_of_copies", "id_is_least")


def queries(own: dict) -> dict:
    """own: the queries opN_<name>. By name: the part of their rows that SQL has."""
    from .common import table

    def part(name, f):
        return lambda spark, sf_dir: f(own[name](spark, sf_dir))

    def ruled():  # a Column needs a session, which there is when a query runs, not yet when queries are listed
        return F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled")

    return {
        "exact1_sizes": part("op1_shards", lambda x: x.select("doc_id", "size", "law")),
        "exact1_shards": part("op1_shards", lambda x: x.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.countDistinct("slot").alias("slots"))),
        "exact2_rules": part("op2_url_filters", lambda x: x.select("page_id", "host", "path", "rule", ruled())),
        "exact3_letters": part("op3_language", lambda x: x.select("doc_id", (F.col("lang_pred") == "und").alias("no_letter"))),
        "exact5_likeness": part("op5_fingerprints", lambda x: x.select("doc_id", "n_chars", "edited_sha256", "near_edited", "near_next")),
        "exact6_base": part("op6_secrets", lambda x: x.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")),
        "exact7_round_trip": part("op7_byte_bpe", lambda x: x.select("doc_id", "decoded_sha256")),
        "exact8_places": part("op8_packing", exact8),
        "exact10_copies": lambda spark, sf_dir: exact10(own["op10_near_dedup"](spark, sf_dir), table(spark, sf_dir, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_suffix_dedup": OP4, "op9_quality": OP9, "exact1_sizes": EXACT1, "exact1_shards": EXACT1_SHARDS, "exact2_rules": EXACT2, "exact3_letters": EXACT3, "exact5_likeness": EXACT5,
        "exact6_base": _exact6(), "exact7_round_trip": EXACT7, "exact8_places": EXACT8, "exact10_copies": EXACT10,
    }
