"""Helpers shared by the text operators: unused column names, checkpoints, Arrow batches in bounded pieces."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that `df` doesn't have, made from `names` (names are compared without case, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def others(df: DataFrame, names: Iterable[str]) -> list[str]:
    """The columns of `df` whose names aren't among `names`, compared without case."""
    added = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in added]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder: what spark.checkpoint.dir names. Where nothing does, a folder of this machine in local
    mode, which has no other; on a cluster, executors wouldn't share it, so an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Arrow batches to workers of about this size for what runs inside."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, was)


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def saved(df: DataFrame) -> Iterator[DataFrame]:
    """Like checkpointed(), as a compressed table that is there while what is inside runs."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    try:
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        removed(df.sparkSession, path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder, of whatever file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@cache
def _trim():
    """glibc's malloc_trim, or a function that does nothing where the C library has none."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


_remembered: dict = {}


def remembered(name: str, make):
    """What `make` makes, kept by this worker from task to task until given_back() comes from other work than this."""
    if name not in _remembered:
        _remembered.clear()
        _remembered[name] = make()
    return _remembered[name]


def given_back(but: str | None = None) -> None:
    """Memory that this worker has freed goes back to the system, and what it remembers from other work than `but` with it, so that
    workers which rest, or go on to other work, hold little."""
    for name in [n for n in _remembered if n != but]:
        del _remembered[name]
    pa.default_memory_pool().release_unused()
    _trim()(0)


def pieces(batches: Iterable[pa.RecordBatch], column: str, most: int, row_bytes: int = 0) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a piece's `column` has about `most` bytes; a longer single row is a piece of its own.
    row_bytes: what each row counts beside its bytes."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        sizes = [n + row_bytes for n in pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()]
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(sizes):
            yield batch.slice(start)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(quoted(column)), F.lit(""))
