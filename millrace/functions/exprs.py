"""Scalar semantics that differ from Spark's own, as Column expressions inside code generation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INT, UINT, FLOAT, STRING, BOOL = T.LongType(), T.DecimalType(20, 0), T.DoubleType(), T.StringType(), T.BooleanType()
#: Fixed value: buckets of time start from this Monday, 2000-01-03, in microseconds.
ORIGIN_US = 946857600000000
#: Widths of interval units in microseconds.
UNITS = {"microsecond": 1, "millisecond": 1000, "second": 1000000, "minute": 60000000, "hour": 3600000000, "day": 86400000000, "week": 604800000000}


class DialectError(ValueError):
    """A statement that the dialect doesn't allow."""


def int_div(a: Column, b: Column) -> Column:
    """Truncating; by zero null."""
    return F.when(b != 0, (a - F.call_function("try_mod", a, b)).cast("decimal(20,0)") / b.cast("decimal(20,0)")).cast(INT)


def float_div(a: Column, b: Column) -> Column:
    """As IEEE: by zero an infinity, or NaN of zero and NaN."""
    by_zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast(FLOAT)).when(b == 0, by_zero).otherwise(a / b)


def decimal_div(a: Column, b: Column) -> Column:
    """A double; by zero null."""
    return F.when(b != 0, a.cast(FLOAT) / b.cast(FLOAT))


def modulo(a: Column, b: Column) -> Column:
    """The sign of the dividend; by zero null."""
    return F.call_function("try_mod", a, b)


def equal(a: Column, b: Column, floats: bool = False) -> Column:
    """NaN equals nothing."""
    return (a == b) & ~F.isnan(a) if floats else a == b


def substr(s: Column, start: Column, length: Column | None = None) -> Column:
    """The window [start, start + length) of places from 1 on; what lies before 1 counts but is empty."""
    first = F.greatest(start, F.lit(1))
    if length is None:
        return s.substr(first.cast("int"), F.length(s))
    length = F.when(length < 0, F.raise_error(F.lit("negative substring length")).cast(INT)).otherwise(length)
    last = F.least(start + length, F.length(s) + 1)
    return s.substr(first.cast("int"), F.greatest(last - first, F.lit(0)).cast("int"))


def text(x: Column, kind: T.DataType) -> Column:
    """Canonical text."""
    if isinstance(kind, T.BinaryType):
        return F.concat(F.lit("\\x"), F.lower(F.hex(x)))
    if isinstance(kind, T.TimestampType):
        return F.concat(F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.unix_micros(x) % 1000000 != 0, F.regexp_replace(F.date_format(x, ".SSSSSS"), "0+$", "")).otherwise(""), F.lit("Z"))
    return x.cast(STRING)


#: The texts that are read as values, by type; Spark's own casts accept more.
TEXT_FORMS = {
    T.LongType: r"^\s*[+-]?[0-9]+\s*$", T.DoubleType: r"^\s*[+-]?((([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)|inf|Infinity|NaN|nan)\s*$", T.BooleanType: r"(?i)^\s*(true|t|1|false|f|0)\s*$",
    T.DateType: r"^\s*[0-9]{4,}-[0-9]{2}-[0-9]{2}\s*$", T.TimestampType: r"^\s*[0-9]{4,}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,9})?Z?)?\s*$", T.BinaryType: r"^\\x([0-9a-fA-F]{2})*$",
}


def parsed(s: Column, kind: T.DataType) -> Column:
    """The value of a text, null if it isn't one."""
    if isinstance(kind, T.StringType):
        return s
    form = r"^\s*[+-]?[0-9]*(\.[0-9]{0,%d}0*)?\s*$" % kind.scale if isinstance(kind, T.DecimalType) else TEXT_FORMS[type(kind)]
    value = F.unhex(F.substring(s, 3, 1 << 30)) if isinstance(kind, T.BinaryType) else F.regexp_replace(F.trim(s), "Z$", "").try_cast(kind)
    return F.when(s.rlike(form), value)


def cast(x: Column, have: T.DataType, want: T.DataType) -> Column:
    """Numbers round half away from zero; what doesn't fit is an error."""
    if have == want:
        return x
    if isinstance(want, T.StringType):
        return text(x, have)
    if isinstance(have, T.StringType):
        value = parsed(x, want)
        return F.when(x.isNotNull() & value.isNull(), F.raise_error(F.concat(F.lit("not a value of the type: "), x)).cast(want)).otherwise(value)
    if isinstance(have, (T.DoubleType, T.DecimalType)) and isinstance(want, T.LongType):
        return F.round(x).cast(want)
    return x.cast(want)


def time_bucket(width_us: int, ts: Column, origin_us: int = ORIGIN_US) -> Column:
    us = F.unix_micros(ts.cast("timestamp"))
    return F.timestamp_micros(us - F.pmod(us - F.lit(origin_us), F.lit(width_us)))


def interval_us(words: str) -> int:
    """Microseconds of '2 hours'; months and years have no fixed width."""
    m = re.fullmatch(r"\s*(\d+)\s*([a-z]+?)s?\s*", words.lower())
    if not m or m[2] not in UNITS:
        raise DialectError(f"interval of no fixed width: {words}")
    return int(m[1]) * UNITS[m[2]]


def extract(part: str, x: Column) -> Column:
    """A long. Sunday is day 0; seconds are whole; milliseconds and microseconds hold the seconds too."""
    us = F.pmod(F.unix_micros(x.cast("timestamp")), F.lit(60000000))
    out = {
        "year": lambda: F.year(x), "quarter": lambda: F.quarter(x), "month": lambda: F.month(x), "week": lambda: F.weekofyear(x), "day": lambda: F.dayofmonth(x), "dow": lambda: F.dayofweek(x) - 1, "doy": lambda: F.dayofyear(x), "hour": lambda: F.hour(x), "minute": lambda: F.minute(x),
        "second": lambda: F.floor(us / 1000000), "millisecond": lambda: F.floor(us / 1000), "microsecond": lambda: us, "epoch": lambda: F.floor(F.unix_micros(x.cast("timestamp")) / 1000000),
    }.get(part.lower())
    if not out:
        raise DialectError(f"unknown part: {part}")
    return out().cast(INT)


def date_trunc(unit: str, x: Column) -> Column:
    if unit.lower() not in {*UNITS, "month", "quarter", "year"}:
        raise DialectError(f"unknown unit: {unit}")
    return F.date_trunc(unit, x.cast("timestamp"))


def regexp_match(s: Column, pattern: str) -> Column:
    """Anywhere in the text; lazy repeats, back references, look-around and word edges aren't in the dialect."""
    if re.search(r"[*+?}][?+]|\\[bB1-9AzZ]|\(\?(?!:)", pattern):
        raise DialectError(f"not in the pattern language: {pattern}")
    re.compile(pattern)
    return s.rlike(pattern)


def like(s: Column, pattern: str, ignore_case: bool = False) -> Column:
    if re.search(r"(?<!\\)(\\\\)*\\$", pattern):
        raise DialectError("pattern ends with an escape")
    pattern = re.sub(r"\\([^%_\\])", r"\1", pattern)
    return s.ilike(pattern) if ignore_case else s.like(pattern)


def in_network(ip: Column, network: str) -> Column:
    """Whether a 16-byte address (IPv4 mapped) lies in a network such as 10.0.0.0/8."""
    import ipaddress

    net = ipaddress.ip_network(network)
    bits = net.prefixlen + (96 if net.version == 4 else 0)
    raw = (b"\0" * 10 + b"\xff\xff" + net.network_address.packed) if net.version == 4 else net.network_address.packed
    digits, rest = divmod(bits, 4)
    hex_, want = F.hex(ip), raw.hex().upper()
    out = F.substring(hex_, 1, digits) == want[:digits]
    if rest:
        value = F.conv(F.substring(hex_, digits + 1, 1), 16, 10).cast("int")
        out = out & (F.shiftright(value, 4 - rest) == int(want[digits], 16) >> (4 - rest))
    return out
