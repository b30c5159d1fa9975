"""CSV and NDJSON into typed columns. A value that doesn't fit its column goes, as text, to the companion `<column>::string`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import DialectError, parsed

SUFFIX = "::string"
ABSENT = "\u0001"


def q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def data_columns(schema: T.StructType) -> list[str]:
    """The columns that positions count: all but companions."""
    return [f.name for f in schema if not f.name.endswith(SUFFIX)]


def routed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of text to the schema's types. Without a companion a value that doesn't fit is an error naming the column."""
    known = set(df.columns)
    out = []
    for f in schema:
        base = f.name.removesuffix(SUFFIX)
        if f.name != base and base in schema.names and f.name not in known:
            raw = F.col(q(base)) if base in known else F.lit(None).cast("string")
            out.append(F.when(parsed(raw, schema[base].dataType).isNull(), raw).alias(f.name))
        elif f.name not in known:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
        else:
            raw = F.col(q(f.name))
            value = F.from_json(raw, f.dataType) if isinstance(f.dataType, T.ArrayType) else parsed(raw, f.dataType)
            if f.name + SUFFIX not in schema.names:
                wrong = F.raise_error(F.concat(F.lit(f"column {f.name}: not a {f.dataType.simpleString()}: "), raw)).cast(f.dataType)
                value = F.when(raw.isNotNull() & value.isNull(), wrong).otherwise(value)
            out.append(value.alias(f.name))
    return df.select(*out)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True, delimiter: str = ",", columns: list[str] | None = None) -> DataFrame:
    """RFC 4180: quotes hold delimiters and line ends; an unquoted empty field is null, a quoted one is ''; blank lines are skipped."""
    names = columns or data_columns(schema)
    options = {"header": header, "sep": delimiter, "quote": '"', "escape": '"', "multiLine": True, "nullValue": ABSENT, "emptyValue": "", "mode": "FAILFAST", "enforceSchema": False}
    if header:
        head = spark.read.options(**options | {"inferSchema": False}).csv(path).columns
        if unknown := [h for h in head if h not in names]:
            raise DialectError(f"unknown column in the header: {unknown[0]}")
        names = head
    texts = spark.read.options(**options).schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(path)
    return routed(texts.select([F.when(F.col(q(n)) != ABSENT, F.col(q(n))).alias(n) for n in names]), schema)


def leaves(schema: T.StructType, path: tuple[str, ...] = ()) -> list[tuple[str, Column]]:
    """(dotted name, value) of all leaves of nested objects."""
    out = []
    for f in schema:
        here = (*path, f.name)
        if isinstance(f.dataType, T.StructType):
            out += leaves(f.dataType, here)
        else:
            x = F.col(".".join(map(q, here)))
            out.append((".".join(here), F.to_json(x) if isinstance(f.dataType, T.ArrayType) else x.cast("string")))
    return out


def read_ndjson(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """An object a line; nested objects are dotted names, numbers keep their text until the column's type reads it."""
    raw = spark.read.option("primitivesAsString", True).option("mode", "FAILFAST").json(path)
    found: dict[str, list[Column]] = {}
    for name, x in leaves(raw.schema):
        found.setdefault(name, []).append(x)
    if unknown := [n for n in found if n not in schema.names]:
        raise DialectError(f"unknown key: {unknown[0]}")
    return routed(raw.select(*[F.coalesce(*xs).alias(n) for n, xs in found.items()]), schema)


def files(spark: SparkSession, path: str) -> DataFrame:
    """A file, or those that a pattern names, as they lie: CSV with a header, NDJSON with nested names as paths, or Parquet."""
    end = path.rsplit(".", 1)[-1].lower()
    if end == "csv":
        return spark.read.csv(path, header=True, inferSchema=True, quote='"', escape='"', multiLine=True)
    if end == "parquet":
        return spark.read.parquet(path)
    if end not in ("ndjson", "jsonl", "json"):
        raise DialectError(f"unknown format: {path}")
    df = spark.read.json(path)

    def leaves(fields, before=()):
        for f in fields:
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, (*before, f.name))
            else:
                yield F.col(".".join(map(q, (*before, f.name)))).alias(".".join((*before, f.name)))

    return df.select(*leaves(df.schema))
