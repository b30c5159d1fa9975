"""Aggregates. Those of one pass are Columns; those that need counts of values first are grouped frames.

A grouped frame has the group columns and `value`; `joined` puts such frames beside the groups, null keys included. Counting
comes before gathering, so a group's rows never meet in one place, only its distinct values, or buckets of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the sketch's relative error.
ALPHA = 0.01


def total(x: Column, kind: T.DataType) -> Column:
    """Overflow is an error; decimals keep their scale at full precision."""
    return F.sum(x.cast(T.DecimalType(38, kind.scale)) if isinstance(kind, T.DecimalType) else x).cast(T.DecimalType(38, kind.scale) if isinstance(kind, T.DecimalType) else kind)


def mean(x: Column, kind: T.DataType) -> Column:
    """A double, summed exactly for integers and decimals."""
    if isinstance(kind, T.DoubleType):
        return F.avg(x)
    scale = kind.scale if isinstance(kind, T.DecimalType) else 0
    return F.sum(x.cast(T.DecimalType(38, scale))).cast("double") / F.count(x)


def list_agg(x: Column, where: Column | None = None) -> Column:
    """Nulls stay; no rows give null."""
    boxed = F.struct(x.alias("x"))
    rows = F.collect_list(boxed if where is None else F.when(where, boxed))
    return F.when(F.size(rows) > 0, F.transform(rows, lambda s: s["x"]))


def approx_count_distinct(x: Column) -> Column:
    return F.approx_count_distinct(x, 0.008)


def counted(df: DataFrame, keys: list[str], x: Column) -> DataFrame:
    return df.groupBy(*keys, x.alias("v")).agg(F.count(F.lit(1)).alias("n"))


def quantile(df: DataFrame, keys: list[str], x: Column, q: float) -> DataFrame:
    """The value of rank floor(q (n - 1)), of the type of x."""
    w = Window.partitionBy(*keys)
    up = w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    c = counted(df, keys, x).filter("v is not null").select(*keys, "v", F.sum("n").over(up).alias("upto"), F.sum("n").over(w).alias("all"))
    return c.filter(F.col("upto") > F.floor(F.lit(float(q)) * (F.col("all") - 1))).groupBy(*keys).agg(F.min("v").alias("value"))


def histogram(df: DataFrame, keys: list[str], x: Column) -> DataFrame:
    """'{a=2, b=1}' ascending, null last."""
    rows = F.array_sort(F.collect_list(F.struct(F.col("v").isNull().alias("z"), "v", "n")))
    shown = F.transform(rows, lambda e: F.concat(F.coalesce(e["v"].cast("string"), F.lit("NULL")), F.lit("="), e["n"].cast("string")))
    return counted(df, keys, x).groupBy(*keys).agg(F.concat(F.lit("{"), F.array_join(shown, ", "), F.lit("}")).alias("value"))


def top_k(df: DataFrame, keys: list[str], x: Column, k: int) -> DataFrame:
    """The k most frequent values, ties ascending."""
    if k <= 0:
        raise ValueError("top_k needs k > 0")
    best = Window.partitionBy(*keys).orderBy(F.col("n").desc(), F.col("v").asc())
    c = counted(df, keys, x).filter("v is not null").withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k)
    return c.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "v"))), lambda e: e["v"]).alias("value"))


def approx_quantile(df: DataFrame, keys: list[str], x: Column, q: float, alpha: float = ALPHA) -> DataFrame:
    """A sketch of logarithmic buckets: a double within alpha of the value, relatively. NaN and nulls are skipped."""
    gamma = (1 + alpha) / (1 - alpha)
    v = x.cast("double")
    rows = df.select(*keys, v.alias("x")).filter("x is not null and not isnan(x)")
    rows = rows.select(*keys, F.signum("x").cast("int").alias("sign"), F.when(F.col("x") != 0, F.ceil(F.log(F.abs("x")) / math.log(gamma))).otherwise(0).alias("k"))
    rows = rows.groupBy(*keys, "sign", "k").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys)
    place = F.col("sign") * F.col("k")
    up = w.orderBy("sign", place).rowsBetween(Window.unboundedPreceding, 0)
    c = rows.select(*keys, "sign", "k", place.alias("p"), F.sum("n").over(up).alias("upto"), F.sum("n").over(w).alias("all"))
    hit = c.filter(F.col("upto") > F.lit(float(q)) * (F.col("all") - 1)).groupBy(*keys).agg(F.min(F.struct("sign", "p", "k")).alias("m"))
    return hit.select(*keys, (F.col("m.sign") * 2 * F.pow(F.lit(gamma), F.col("m.k")) / (gamma + 1)).alias("value"))


def joined(groups: DataFrame, keys: list[str], frames: dict[str, DataFrame]) -> DataFrame:
    """The groups with a column of each frame's values, null where a group has none."""
    for name, frame in frames.items():
        right = frame.select(*[F.col(k).alias(f"{k}__of_{name}") for k in keys], F.col("value").alias(name))
        on = F.lit(True)
        for k in keys:
            on = on & groups[k].eqNullSafe(right[f"{k}__of_{name}"])
        groups = groups.join(right, on, "left").select(*groups.columns, name)
    return groups
