"""Threshold-scaled document fingerprints. DataFrame functions only.

A fingerprint keeps every hash of a five-word shingle below a fixed share of the hash range, so the fingerprint of a union
is the union of fingerprints, and a small document's containment in a large one can be estimated. The share is the whole
range unless another is given: then containment is exact, for texts of a few words too. Of a smaller share a short text may
keep no hash; it then has an empty fingerprint, which says nothing of it.

Defined results: null texts are empty; a text without words has an empty fingerprint (likeness 1 to another such, else 0);
texts of one to four words are one shingle. Words are separated by ASCII white space. Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, quoted

#: Words of a shingle, and the share of hashes that are kept.
SHINGLE, SHARE = 5, 1.0
#: Bytes of a range of keys, about, and ranges at most: their bounds are part of the plan. Larger ranges are sorted on disk.
RANGE_BYTES, RANGES = 8 << 20, 20_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, "\t\n\x0b\f\r", "     "), " "), lambda w: w != "")


def hashes_of(words: Column, shingle: int = SHINGLE) -> Column:
    at = F.sequence(F.lit(1), F.greatest(F.size(words) - shingle + 1, F.lit(1)))
    return F.when(F.size(words) > 0, F.transform(at, lambda i: F.xxhash64(F.slice(words, i, shingle)))).otherwise(F.array().cast("array<bigint>"))


def small_of(hashes: Column, share: float = SHARE) -> Column:
    small = hashes if share >= 1 else F.filter(hashes, lambda h: h < int(-(2**63) + share * 2**64))
    return F.array_sort(F.array_distinct(small))


def fingerprinted(df: DataFrame, name: str, text: str = "text", shingle: int = SHINGLE, share: float = SHARE) -> DataFrame:
    """`df` with the fingerprint of `text` (array of long) as `name`."""
    words, hashes = fresh(df, "fingerprint_words", "fingerprint_hashes")
    out = df.withColumn(words, words_of(F.coalesce(F.col(quoted(text)), F.lit("")))).withColumn(hashes, hashes_of(F.col(words), shingle))
    return out.withColumn(name, small_of(F.col(hashes), share)).drop(words, hashes)


def merged(fingerprints: Column) -> Column:
    """The fingerprint of all texts of an array of fingerprints."""
    return F.array_sort(F.array_distinct(F.flatten(fingerprints)))


def containment(a: Column, b: Column) -> Column:
    """The share of a's shingles that b has, estimated if fingerprints are of a share below 1."""
    return F.when(F.size(a) == 0, F.when(F.size(b) == 0, 1.0).otherwise(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def likeness(a: Column, b: Column) -> Column:
    """The containment of the smaller in the larger."""
    return F.greatest(containment(a, b), containment(b, a))


def written(fingerprint: Column) -> Column:
    """As text: the hashes in hexadecimal digits, ascending as signed numbers, with a comma between."""
    return F.array_join(F.transform(fingerprint, lambda h: F.hex(h)), ",")


def with_next(df: DataFrame, columns: list[str], key: str, then: str, parts: int | None = None, after: Callable[[DataFrame], DataFrame] | None = None, more: Sequence[str] = ()) -> DataFrame:
    """`df` with struct `then` of the columns in the row of the next larger key; after the last comes the first.

    after: adds columns once rows have been dealt, so that these needn't travel; those named in `more` are in `then` as well.
    Rows are dealt to ranges of keys, with the first row of each range also at the end of the range before. Rows of the same
    key follow each other in an order drawn from their place in the input, which also splits a key of many rows over ranges; so
    the input must give its rows in the same order when it is read again, as tables do. Null keys come last."""
    k, part, tie, at = fresh(df, "range_key", "range_part", "range_tie", "range_place")
    kinds = dict(df.dtypes)
    size = sum((F.coalesce(F.octet_length(quoted(c)), F.lit(0)).cast("long") for c in columns if kinds[c] in ("string", "binary")), F.lit(16))
    rows, low, high, total = df.select(F.col(quoted(key)).alias(k), size.alias(part)).agg(F.count(F.lit(1)), F.min(k), F.max(k), F.sum(part)).first()
    if not rows:
        return (after(df) if after else df).withColumn(then, F.struct(*map(quoted, [*columns, *more])))
    low, high = (0, 0) if low is None else (low, high)
    parts = parts or max(1, min(RANGES, -(-total // RANGE_BYTES)))
    keyed = df.withColumns({k: F.coalesce(F.col(quoted(key)).cast("decimal(20,0)"), F.lit(high).cast("decimal(20,0)") + 1), tie: F.xxhash64(F.monotonically_increasing_id())})
    # a number that grows with (key, tie); several rows may share it, which then share a range
    keyed = keyed.withColumn(at, (F.col(k) - F.lit(low).cast("decimal(20,0)")).cast("double") + (F.col(tie) / 2.0**64 + 0.5))
    found = keyed.agg(F.percentile_approx(at, [i / parts for i in range(1, parts)] or [0.5], max(10_000, 4 * parts))).first()[0]
    bounds = sorted(set(found)) if parts > 1 else []
    number = F.lit(0)
    if bounds:
        width = max(1, int(len(bounds) ** 0.5))
        coarse, fine = bounds[::width], [bounds[i : i + width] for i in range(0, len(bounds), width)]
        group = F.size(F.filter(F.array(*map(F.lit, coarse)), lambda b: b <= F.col(at)))
        inside = F.element_at(F.array(*[F.array(*map(F.lit, f)) for f in fine]), F.greatest(group, F.lit(1)))
        number = F.when(group == 0, 0).otherwise((group - 1) * width + F.size(F.filter(inside, lambda b: b <= F.col(at))))
    first = F.min(F.struct(k, tie)).alias("f")
    firsts = {r[0]: (r.f[0], r.f[1]) for r in keyed.select(number.alias(part), k, tie).groupBy(part).agg(first).collect()}  # a row for each range
    there = sorted(firsts)
    before = dict(zip(there, [there[-1], *there[:-1]]))
    every = range(len(bounds) + 1)
    key_of = F.array(*[F.lit(str(firsts[i][0]) if i in firsts else None).cast("decimal(20,0)") for i in every])
    tie_of = F.array(*[F.lit(firsts[i][1] if i in firsts else None).cast("long") for i in every])
    before_of = F.array(*[F.lit(before.get(i)).cast("int") for i in every])
    own = F.struct(F.col(part).alias("part"), F.lit(False).alias("copy"))
    again = F.struct(F.element_at(before_of, F.col(part) + 1).alias("part"), F.lit(True).alias("copy"))
    placed = keyed.withColumn(part, number.cast("int"))
    is_first = (F.col(k) == F.element_at(key_of, F.col(part) + 1)) & (F.col(tie) == F.element_at(tie_of, F.col(part) + 1))
    placed = placed.withColumn(part, F.explode(F.when(is_first, F.array(own, again)).otherwise(F.array(own))))
    placed = placed.withColumns({at: F.col(f"{part}.copy"), part: F.col(f"{part}.part")})
    placed = placed.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(there)), part)  # as the window needs them
    order = Window.partitionBy(part).orderBy(at, k, tie)
    led = (after(placed) if after else placed).withColumn(then, F.lead(F.struct(*map(quoted, [*columns, *more]))).over(order))
    return led.filter(~F.col(at)).drop(k, part, tie, at)


def edited(text: Column, following: Column) -> Column:
    """The text with its last floor(n / 2) code points replaced by the first as many (or all) of the following one."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))
