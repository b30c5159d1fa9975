"""Two-pass external shuffle into shards.

Pass one scatters the rows by a seeded hash over buckets that fit in memory; pass two permutes each bucket with a
Fisher-Yates shuffle. Buckets laid end to end are one random order of all rows, which is cut into equal shards.

Defined results: the hash covers the key and the text, so equal rows share a bucket and are interchangeable; a bucket
that repeated rows make larger than four times the aim is split by row number. Null keys and texts hash like values.
Equal texts of different keys are not kept together. An empty table gives no rows. A text longer than a bucket is a bucket
with it. Extra columns pass through (shard and slot: replaced). The same rows and seed give the same shards in any layout
of the input (split buckets excepted: they follow the layout).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, fresh, others, quoted

#: Buckets whose rows are summed together, before the sums of such groups are.
GROUP = 4096
#: Bytes of text that a bucket aims at; a worker holds one bucket.
BUCKET_BYTES = 16 << 20


def fisher_yates(n: int, seed: int) -> list[int]:
    """A permutation of range(n): from the end, each place swaps with a random one up to it."""
    draws = np.random.Generator(np.random.PCG64(seed)).random(n)
    order = list(range(n))
    for i in range(n - 1, 0, -1):
        j = int(draws[i] * (i + 1))
        order[i], order[j] = order[j], order[i]
    return order


def shuffled(df: DataFrame, seed: int, key: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES, position: str = "position") -> tuple[DataFrame, int]:
    """`df` with `position`, a random gapless order from 0, and its number of rows."""
    h, b, size, n, first, whose = fresh(df, "scatter_hash", "scatter_bucket", "scatter_bytes", "scatter_rows", "scatter_first", "scatter_of")
    size_of = F.coalesce(F.octet_length(F.col(quoted(text))), F.lit(0)).cast("long") + 1
    rows, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size_of), F.lit(0))).first()
    buckets = max(1, math.ceil(total / bucket_bytes))
    hashed = df.withColumn(h, F.xxhash64(F.lit(seed), F.col(quoted(key)), F.col(quoted(text))))
    scattered = hashed.withColumn(b, F.pmod(F.col(h), F.lit(buckets)))
    counts = scattered.groupBy(b).agg(F.count(F.lit(1)).alias(n), F.sum(size_of).alias(size))
    hot = counts.filter((F.col(size) > 4 * bucket_bytes) & (F.col(n) > 1)).select(b, F.ceil(F.col(size) / bucket_bytes).alias(first))
    if not hot.isEmpty():  # repeated rows only: at most a quarter of the buckets. The written copy fixes where each row goes
        turn = F.pmod(F.monotonically_increasing_id(), F.coalesce(F.col(first), F.lit(1)))
        scattered = scattered.join(checkpointed(hot), b, "left").withColumn(b, F.col(b) + buckets * turn).select(*map(quoted, df.columns), h, b)
        scattered = checkpointed(scattered)
        counts = scattered.groupBy(b).agg(F.count(F.lit(1)).alias(n), F.sum(size_of).alias(size))
    # rows before a bucket: those of the groups of buckets before, and those before in its group
    group = F.floor(F.col(b) / GROUP)
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    groups = counts.groupBy(group.alias(size)).agg(F.sum(n).alias(n))
    groups = groups.select(size, F.coalesce(F.sum(n).over(before.orderBy(size)), F.lit(0)).alias(first))
    inside = F.coalesce(F.sum(n).over(before.partitionBy(size).orderBy(b)), F.lit(0))
    firsts = counts.select(b, n, group.alias(size)).withColumn(n, inside).join(groups, size).select(F.col(b).alias(whose), (F.col(first) + F.col(n)).alias(first))
    names = list(df.columns)

    def permute(key, left, right):
        if not left.num_rows:
            return pa.Table.from_arrays([pa.array([], f.type) for f in left.select(names).schema] + [pa.array([], pa.int64())], names=[*names, position])
        left = left.take(pc.sort_indices(left.column(h)))
        order = fisher_yates(left.num_rows, (seed << 40) ^ key[0].as_py())
        start = right.column(first)[0].as_py()
        return left.select(names).take(pa.array(order)).append_column(position, pa.array(np.arange(start, start + len(order))))

    schema = T.StructType([*df.schema.fields, T.StructField(position, T.LongType())])
    return scattered.groupBy(b).cogroup(firsts.groupBy(whose)).applyInArrow(permute, schema), rows


def sharded(df: DataFrame, shards: int, seed: int = 1, key: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """`df` with shard (int, from 0) and slot (long, gapless in each shard). Shards' row counts differ by one at most."""
    df = df.select(*map(quoted, others(df, ("shard", "slot"))))
    (place,) = fresh(df, "shuffle_position")
    out, rows = shuffled(df, seed, key, text, bucket_bytes, place)
    rows = max(rows, 1)
    shard = F.expr(f"{quoted(place)} * {shards} div {rows}")
    return out.withColumn("shard", shard.cast("int")).withColumn("slot", F.col(place) - F.expr(f"(shard * {rows}L + {shards - 1}) div {shards}")).drop(place)


def write_shards(df: DataFrame, path: str, shards: int, **more) -> None:
    """One folder a shard, its rows in slot order."""
    sharded(df, shards, **more).repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
