"""Relational operators beyond Spark's own: null order, joins that NaN never matches, limits per group, gap filling, as-of joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import time_bucket
from ..sources.ingest import q


def order(key: Column, desc: bool = False, nulls_first: bool | None = None) -> Column:
    """Nulls come last ascending, first descending, unless told."""
    first = desc if nulls_first is None else nulls_first
    return (key.desc_nulls_first() if first else key.desc_nulls_last()) if desc else (key.asc_nulls_first() if first else key.asc_nulls_last())


def top(df: DataFrame, keys: list[Column], limit: int | None, offset: int = 0) -> DataFrame:
    out = df.orderBy(*keys) if keys else df
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def equi_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], how: str = "inner", residual: Column | None = None) -> DataFrame:
    """inner or left; null and NaN keys match nothing. Catalyst and adaptive execution pick the strategy and split skewed keys."""
    if how not in ("inner", "left"):
        raise ValueError(f"{how} join")
    cond = F.lit(True)
    for a, b in on:
        cond = cond & (left[a] == right[b])
        if isinstance(left.schema[a].dataType, (T.DoubleType, T.FloatType)):
            cond = cond & ~F.isnan(left[a])
    return left.join(right, cond if residual is None else cond & residual, how)


def limit_per(df: DataFrame, n: int, per: list[str], keys: list[Column]) -> DataFrame:
    """The first n rows of each group; groups are cut before the exchange."""
    return df.withColumn("rank__", F.row_number().over(Window.partitionBy(*per).orderBy(*keys))).filter(F.col("rank__") <= n).drop("rank__")


def latest(df: DataFrame, key: list[str], version: str | None, sequence: Sequence[str] = ()) -> DataFrame:
    """The newest row of each key: of the largest version, then of what was written last (the largest of `sequence`)."""
    by = [F.col(version).desc_nulls_last()] if version else []
    return limit_per(df, 1, key, by + [F.col(c).desc() for c in sequence])


def nearest_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, columns: list[str], how: str = "left") -> DataFrame:
    """Each left row with the columns of the right row of equal keys and the last time not after its own. Null keys and null
    times match nothing; left rows without a match stay, with nulls, unless `how` is inner.

    Both sides are laid in one order of time for each key, and the last right row is carried on: no pairs are made."""
    known = reduce(Column.__and__, [F.col(c).isNotNull() for c in on], F.lit(True))
    base = left.select("*", F.lit(1).alias("side__"), F.when(known, F.col(left_time)).alias("at__"))
    # rows that can't match are dealt by themselves, so that many null keys aren't one task's
    lone = F.when(~known | F.col(left_time).isNull(), F.monotonically_increasing_id())
    base = base.withColumn("lone__", lone)
    other = right.filter(known & F.col(right_time).isNotNull())
    other = other.select(*on, F.col(right_time).alias("at__"), F.lit(0).alias("side__"), F.lit(None).cast("long").alias("lone__"), F.struct(*columns).alias("match__"))
    both = base.unionByName(other, allowMissingColumns=True)
    w = Window.partitionBy(*on, "lone__").orderBy("at__", "side__").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("match__", F.last("match__", ignorenulls=True).over(w)).filter("side__ = 1")
    out = out.filter("match__ is not null") if how == "inner" else out
    return out.select(*left.columns, *[F.col(f"match__.{c}").alias(c) for c in columns])


def gap_filled(df: DataFrame, time: str, width_us: int, value: str | list[str], keys: list[str], fill: str = "zero") -> DataFrame:
    """df has a row for each key and bucket; missing buckets between a key's first and last are filled: zero, previous or linear.
    Null keys are a key like others; rows without a time stay as they are."""
    values = [value] if isinstance(value, str) else value
    names = {c: f"{c}__of_gap" for c in [*keys, time]}
    spans = df.filter(F.col(q(time)).isNotNull()).groupBy(*map(q, keys)).agg(F.min(q(time)).alias("a__"), F.max(q(time)).alias("z__"))
    step = F.expr(f"make_dt_interval(0, 0, 0, {width_us} / 1000000)")
    spine = spans.select(*[F.col(q(k)).alias(names[k]) for k in keys], F.explode(F.sequence("a__", "z__", step)).alias(names[time]))
    same = reduce(Column.__and__, [F.col(q(names[c])).eqNullSafe(F.col(q(c))) for c in names])
    full = spine.join(df.select(*map(q, [*keys, time, *values])), same, "left").select(*[F.col(q(n)).alias(c) for c, n in names.items()], *map(q, values))
    w = Window.partitionBy(*map(q, keys)).orderBy(q(time))
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    t = F.unix_micros(q(time))

    def filled(c):
        x = F.col(q(c))
        if fill == "zero":
            return F.coalesce(x, F.lit(0))
        if fill == "previous":
            return F.last(x, ignorenulls=True).over(before)
        known = F.when(x.isNotNull(), F.struct(t.alias("t"), x.cast("double").alias("v")))
        a, b = F.last(known, ignorenulls=True).over(before), F.first(known, ignorenulls=True).over(after)
        return F.coalesce(x.cast("double"), a["v"] + (b["v"] - a["v"]) * (t - a["t"]) / (b["t"] - a["t"]))

    out = full.select(*map(q, [*keys, time]), *[filled(c).alias(c) for c in values])
    return out.unionByName(df.filter(F.col(q(time)).isNull()).select(*[F.col(q(c)).cast(out.schema[c].dataType).alias(c) for c in out.columns]))


def bucketed(df: DataFrame, time: str, width_us: int, keys: list[str], *aggregates: Column) -> DataFrame:
    return df.groupBy(*keys, time_bucket(width_us, F.col(time)).alias("bucket")).agg(*aggregates)


def nearest_vectors(df: DataFrame, column: str, query: list[float], k: int, key: str) -> DataFrame:
    """The k rows of the largest cosine, exactly."""
    q = F.array(*map(F.lit, query)).cast("array<double>")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    score = dot(F.col(column), q) / F.sqrt(dot(F.col(column), F.col(column)) * dot(q, q))
    return df.withColumn("score", score).orderBy(F.desc("score"), key).limit(k)
