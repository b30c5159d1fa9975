"""Quality rules: counts of a text, and lines that a host repeats over documents.

Lines, lower-cased with digits and runs of white space made equal, are hashed; for each host the distinct documents that
hold a line are counted, copies included. Lines above the host's limit are removed, and a depleted document is rejected:
one that keeps too few of its words, or too small a share of them.

Defined results: null texts have no words and aren't counted; each row is a document; a null host is a host of its own;
lines without a word are not counted. Repeated rows get equal verdicts. A very long text is handled as a whole in one row.
Extra columns pass through (of the same name as a result: replaced).
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, others, quoted

#: A line is removed if over LEAST_LINES documents of its host have it and over SHARE of them.
LEAST_LINES, SHARE = 20, 0.02
#: A document is rejected if it keeps a smaller share of its words, or fewer words than a document needs in the first place.
LEAST_KEPT, LEAST_WORDS = 0.3, 50
#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(text: str | None) -> tuple[int, int, int, int, int]:
    """STATS of a text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # ASCII white space only
    space = len(raw) - sum(map(len, words))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    repeated, distinct = 0, set(windows)
    if len(distinct) < len(windows):
        many = {w for w, n in Counter(windows).items() if n > 1}
        reach = 0
        for i, w in enumerate(windows):
            if w in many:
                repeated += i + 3 - max(i, reach)
                reach = i + 3
    return len(words), len(text) - space, sum(map(raw.count, SYMBOLS.encode())), len(lines) - len(set(lines)), repeated


def normalised(text: Column) -> Column:
    """A line, or lines, as they are compared: lower-cased, digits as 0, white space within a line as one space."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]+", "0"), "[ \t\x0b\f\r]+", " ")


def lines_of(text: Column) -> Column:
    """The lines of a text that have a word: (hash of the normalised line, its words)."""
    lines = F.filter(F.transform(F.split(normalised(text), "\n"), lambda s: F.trim(s)), lambda s: s != "")
    return F.transform(lines, lambda s: F.struct(F.xxhash64(s).alias("line"), (F.length(s) - F.length(F.translate(s, " ", "")) + 1).alias("words")))


def without_lines(text: Column, lines: Column) -> Column:
    """The text without the lines of these hashes."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda s: ~F.array_contains(lines, F.xxhash64(F.trim(normalised(s))))), "\n")


def judged(
    df: DataFrame, host: str = "source", text: str = "text", least_lines: int = LEAST_LINES, share: float = SHARE, least_kept: float = LEAST_KEPT,
    least_words: int = LEAST_WORDS, clean: str | None = None,
) -> DataFrame:
    """`df` with STATS, base_failed, kept_share (of the words, after the removal of lines) and kept.
    clean: also the text without the removed lines, under this name."""
    added = (*STATS, "base_failed", "kept_share", "kept", *([clean] if clean else []))
    kept = others(df, added)
    h, s, whole, own = fresh(df, "text_hash", "host_hash", "whole_text", "own_text")
    keyed = df.withColumns({h: F.xxhash64(quoted(text)), s: F.xxhash64(quoted(host), F.col(quoted(host)).isNull())})
    there = keyed.filter(F.col(quoted(text)).isNotNull()).select(F.col(s).alias("s"), F.col(h).alias("h"), F.col(quoted(text)).alias("t"))
    held = there.select("s", F.explode(F.array_distinct(F.transform(lines_of(F.col("t")), lambda x: x["line"]))).alias("line"))
    hosts = there.groupBy("s").agg(F.count(F.lit(1)).alias("documents"))
    often = held.groupBy("s", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least_lines)
    often = often.join(hosts, "s").filter(F.col("n") > share * F.col("documents")).select("s", "line")
    lines = there.select("s", "h", F.explode(lines_of(F.col("t"))).alias("x")).select("s", "h", "x.line", "x.words")
    sums = [F.sum("words").alias("lost"), *([F.collect_set("line").alias("lines")] if clean else [])]  # a text's lines at most
    lost = lines.join(often, ["s", "line"]).groupBy("s", "h").agg(*sums)
    rows = there.groupBy("s", "h").agg(F.count(F.lit(1)).alias("rows"))
    s_, h_, words_, lines_ = fresh(keyed, "lost_host", "lost_text", "lost_words", "lost_lines")
    carried = [F.col("lines").alias(lines_)] if clean else []
    lost = lost.join(rows, ["s", "h"]).select(F.col("s").alias(s_), F.col("h").alias(h_), (F.col("lost") / F.col("rows")).alias(words_), *carried)

    def run(batches):
        for b in batches:
            columns = list(zip(*map(measured, b.column(whole).to_pylist()))) or [[]] * 5
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in before), *(pa.array(c, pa.int64()) for c in columns)], names=[*before, *STATS])

    before = [*kept, h, s, *([own] if clean else [])]
    schema = T.StructType([*(keyed.withColumn(own, F.col(quoted(text))).schema[c] for c in before), *(T.StructField(c, T.LongType()) for c in STATS)])
    read = [*map(quoted, kept), h, s, *([F.col(quoted(text)).alias(own)] if clean else []), F.col(quoted(text)).alias(whole)]
    stats = keyed.select(*read).mapInArrow(run, schema)
    both = stats.join(lost, (stats[s] == F.col(s_)) & (stats[h] == F.col(h_)), "left")
    n, gone = F.col("n_words"), F.least(F.coalesce(F.col(words_), F.lit(0.0)), F.col("n_words"))
    failed = (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)
    left = F.when(n > 0, 1 - gone / n).otherwise(0.0)
    cleaned = [F.when(F.col(lines_).isNull(), F.col(own)).otherwise(without_lines(F.col(own), F.col(lines_))).alias(clean)] if clean else []
    verdict = ~failed & (left >= least_kept) & (n - gone >= least_words)
    return both.select(*map(quoted, kept), *STATS, failed.alias("base_failed"), left.alias("kept_share"), verdict.alias("kept"), *cleaned)
