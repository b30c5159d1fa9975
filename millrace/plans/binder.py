"""From parsed statements to DataFrames: names, types and the dialect's rules. Plans are left to Catalyst."""

from __future__ import annotations

import datetime
import decimal
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import aggs, exprs
from ..functions.exprs import BOOL, FLOAT, INT, STRING, DialectError
from ..operators import relational
from ..sources import ingest
from ..sources.catalog import Store
from ..sources.ingest import SUFFIX, q
from . import analysis
from .parser import parse

#: The spellings of types.
NAMES = {n: k for k, ns in {INT: "tinyint smallint int integer bigint int2 int4 int8 int64", exprs.UINT: "ubigint uint64", FLOAT: "real float double float4 float8 float64", STRING: "text varchar char string uuid", BOOL: "boolean bool", T.BinaryType(): "blob bytea bytes inet ip", T.TimestampType(): "timestamp", T.DateType(): "date"}.items() for n in ns.split()}
AGGREGATES = {"count", "sum", "avg", "min", "max", "arg_min", "min_by", "arg_max", "max_by", "list", "list_agg", "array_agg", "quantile", "quantile_disc", "histogram", "approx_count_distinct", "approx_quantile", "top_k"}
NUMBERS = (T.LongType, T.DoubleType, T.DecimalType)


def type_of(spelled: tuple) -> T.DataType:
    name, *numbers = spelled
    if name == "list":
        inner = type_of(numbers[0])
        if isinstance(inner, T.ArrayType):
            raise DialectError("a list of lists")
        return T.ArrayType(inner)
    if name in ("decimal", "numeric"):
        p, s = (*numbers, 0)[:2] if numbers else (18, 3)
        if not 1 <= p <= 38 or s > p:
            raise DialectError(f"decimal({p},{s})")
        return T.DecimalType(p, s)
    if name not in NAMES:
        raise DialectError(f"unknown type: {name}")
    return NAMES[name]


def spelled(kind: T.DataType) -> str:
    """A type as the dialect spells it."""
    if isinstance(kind, T.ArrayType):
        return f"LIST<{spelled(kind.elementType)}>"
    if isinstance(kind, T.DecimalType):
        return f"DECIMAL({kind.precision},{kind.scale})"
    return {T.LongType: "BIGINT", T.DoubleType: "DOUBLE", T.StringType: "TEXT", T.BooleanType: "BOOLEAN", T.BinaryType: "BYTES", T.TimestampType: "TIMESTAMP", T.DateType: "DATE"}[type(kind)]


@dataclass
class Typed:
    col: Column
    kind: T.DataType | None  # None: a bare NULL
    literal: object = None


def narrow(kind: T.DataType) -> T.DataType:
    """What a column of the storage layer is in the dialect."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return INT
    return FLOAT if isinstance(kind, T.FloatType) else T.TimestampType() if isinstance(kind, T.TimestampNTZType) else kind


def common(a: T.DataType | None, b: T.DataType | None) -> T.DataType | None:
    """The type that both become."""
    if a is None or b is None or a == b:
        return b if a is None else a
    kinds = {type(a), type(b)}
    if T.DoubleType in kinds and kinds <= set(NUMBERS):
        return FLOAT
    if kinds == {T.LongType, T.DecimalType}:
        d = a if isinstance(a, T.DecimalType) else b
        return T.DecimalType(min(38, max(19 + d.scale, d.precision)), d.scale)
    if kinds == {T.DecimalType}:
        s = max(a.scale, b.scale)
        return T.DecimalType(min(38, max(a.precision - a.scale, b.precision - b.scale) + s), s)
    if kinds == {T.DateType, T.TimestampType}:
        return T.TimestampType()
    raise DialectError(f"{a.simpleString()} and {b.simpleString()} don't go together")


@dataclass
class Scope:
    """Columns by (table alias, name), each with the frame's own column name."""

    df: DataFrame
    columns: list[tuple[str, str, str, T.DataType]]  # alias, name, inner name, type

    def find(self, path: list[str]) -> tuple[str, str, str, T.DataType]:
        tries = [(None, ".".join(path)), *([(path[-2], path[-1])] if len(path) > 1 else [])]
        for of, name in tries:
            hits = [c for c in self.columns if c[1] == name and (of is None or c[0] == of)]
            if len(hits) > 1:
                raise DialectError(f"ambiguous column: {name}")
            if hits:
                return hits[0]
        raise DialectError(f"no such column: {'.'.join(path)}")


@dataclass
class Context:
    warnings: list[str] = field(default_factory=list)
    now: datetime.datetime = field(default_factory=lambda: datetime.datetime.now(datetime.UTC))


def literal(text: str) -> Typed:
    if "e" in text.lower():
        return Typed(F.lit(float(text)), FLOAT, float(text))
    if "." in text:
        d = decimal.Decimal(text)
        digits = text.replace(".", "").lstrip("0") or "0"
        scale = len(text.partition(".")[2])
        kind = T.DecimalType(max(len(digits), scale, 1), scale)
        return Typed(F.lit(d).cast(kind), kind, d)
    n = int(text)
    if n < 2**63:
        return Typed(F.lit(n).cast(INT), INT, n)
    kind = T.DecimalType(len(text), 0)
    return Typed(F.lit(decimal.Decimal(n)).cast(kind), kind, n)


class Binder:
    def __init__(self, engine: Engine, context: Context):
        self.engine, self.context = engine, context
        self.variables: dict[str, Typed] = {}  # of the functions that stand around
        self.score: Column | None = None  # of the rows that MATCH has found

    # expressions

    def bind(self, e: tuple, scope: Scope | None, found: dict | None = None) -> Typed:
        """found: expressions that stand computed in the frame after grouping, by their tuple's text."""
        if found is not None and repr(e) in found:
            return found[repr(e)]
        make = getattr(self, "on_" + e[0].replace(" ", "_"))
        return make(e, scope, found)

    def both(self, a, b, scope, found) -> tuple[Typed, Typed, T.DataType | None]:
        x, y = self.bind(a, scope, found), self.bind(b, scope, found)
        x, y = self.adapted(x, y), self.adapted(y, x)
        kind = common(x.kind, y.kind)
        return x, y, kind

    @staticmethod
    def adapted(x: Typed, other: Typed) -> Typed:
        """A literal text takes the other side's type."""
        if isinstance(x.literal, str) and other.kind is not None and not isinstance(other.kind, T.StringType):
            return Typed(exprs.cast(x.col, STRING, other.kind), other.kind)
        return x

    @staticmethod
    def to(x: Typed, kind: T.DataType | None) -> Column:
        return x.col if kind is None or x.kind == kind else x.col.cast(kind)

    def on_num(self, e, scope, found):
        return literal(e[1])

    def on_str(self, e, scope, found):
        return Typed(F.lit(e[1]), STRING, e[1])

    def on_null(self, e, scope, found):
        return Typed(F.lit(None), None)

    def on_true(self, e, scope, found):
        return Typed(F.lit(True), BOOL, True)

    def on_false(self, e, scope, found):
        return Typed(F.lit(False), BOOL, False)

    def on_date(self, e, scope, found):
        return Typed(exprs.cast(F.lit(e[1]), STRING, T.DateType()), T.DateType())

    def on_timestamp(self, e, scope, found):
        return Typed(exprs.cast(F.lit(e[1]), STRING, T.TimestampType()), T.TimestampType())

    def on_interval(self, e, scope, found):
        raise DialectError("an interval stands only in time_bucket")

    def on_col(self, e, scope, found):
        if len(e[1]) == 1 and e[1][0] in self.variables:
            return self.variables[e[1][0]]
        if found is not None:
            raise DialectError(f"column {'.'.join(e[1])} is neither grouped nor in an aggregate")
        if scope is None:
            raise DialectError(f"no such column: {'.'.join(e[1])}")
        alias, name, inner, kind = scope.find(e[1])
        if any(c[0] == alias and c[1] == name + SUFFIX for c in scope.columns):
            self.warn(name)
        return Typed(F.col(q(inner)), kind)

    def warn(self, name: str) -> None:
        said = f"values of {name} that don't fit are in {name}{SUFFIX}"
        if said not in self.context.warnings:
            self.context.warnings.append(said)

    def on_and(self, e, scope, found):
        return Typed(self.truth(e[1], scope, found) & self.truth(e[2], scope, found), BOOL)

    def on_or(self, e, scope, found):
        return Typed(self.truth(e[1], scope, found) | self.truth(e[2], scope, found), BOOL)

    def on_not(self, e, scope, found):
        return Typed(~self.truth(e[1], scope, found), BOOL)

    def truth(self, e, scope, found=None) -> Column:
        x = self.bind(e, scope, found)
        if not isinstance(x.kind, (T.BooleanType, type(None))):
            raise DialectError(f"a condition of type {x.kind.simpleString()}")
        return x.col.cast(BOOL) if x.kind is None else x.col

    def on_is(self, e, scope, found):
        x = self.bind(e[1], scope, found)
        out = x.col.isNull() if e[2] == "null" else F.coalesce(x.col == F.lit(e[2] == "true"), F.lit(False))
        return Typed(~out if e[3] else out, BOOL)

    def on_cmp(self, e, scope, found):
        x, y, kind = self.both(e[2], e[3], scope, found)
        a, b = self.to(x, kind), self.to(y, kind)
        if e[1] in ("=", "<>"):
            same = exprs.equal(a, b, isinstance(kind, T.DoubleType))
            return Typed(same if e[1] == "=" else ~same, BOOL)
        return Typed({"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[e[1]], BOOL)

    def on_in(self, e, scope, found):
        out = None
        for v in e[2]:
            one = self.on_cmp(("cmp", "=", e[1], v), scope, found).col
            out = one if out is None else out | one
        return Typed(out, BOOL)

    def on_like(self, e, scope, found):
        pattern = self.bind(e[2], scope, found).literal
        if not isinstance(pattern, str):
            raise DialectError("LIKE needs a literal pattern")
        return Typed(exprs.like(self.text(e[1], scope, found), pattern, e[3]), BOOL)

    def text(self, e, scope, found) -> Column:
        x = self.bind(e, scope, found)
        if not isinstance(x.kind, (T.StringType, type(None))):
            raise DialectError(f"text is needed, not {x.kind.simpleString()}")
        return x.col.cast(STRING) if x.kind is None else x.col

    def on_concat(self, e, scope, found):
        return Typed(F.concat(self.text(e[1], scope, found), self.text(e[2], scope, found)), STRING)

    def on_neg(self, e, scope, found):
        if e[1][0] == "num":
            x = literal(e[1][1])
            if x.literal == 2**63:
                return Typed(F.lit(-(2**63)), INT)
            return Typed(-x.col, x.kind, -x.literal)
        x = self.bind(e[1], scope, found)
        if not isinstance(x.kind, NUMBERS):
            raise DialectError("minus needs a number")
        return Typed(-x.col, x.kind)

    def on_arith(self, e, scope, found):
        op = e[1]
        x, y, kind = self.both(e[2], e[3], scope, found)
        if kind is None:
            return Typed(F.lit(None).cast(INT), INT)
        if not isinstance(kind, NUMBERS):
            raise DialectError(f"{op} needs numbers, not {kind.simpleString()}")
        if isinstance(kind, T.DecimalType):
            a, b = ((z.kind if isinstance(z.kind, T.DecimalType) else T.DecimalType(19, 0)) for z in (x, y))
            left, right = x.col.cast(a), y.col.cast(b)
            if op == "/":
                return Typed(exprs.decimal_div(left, right), FLOAT)
            s = a.scale + b.scale if op == "*" else max(a.scale, b.scale)
            if s > 38:
                raise DialectError("a product of too many decimal places")
            p = a.precision + b.precision if op == "*" else max(a.precision - a.scale, b.precision - b.scale) + s + 1
            out = T.DecimalType(min(38, p), s)
            value = {"+": lambda: left + right, "-": lambda: left - right, "*": lambda: left * right, "%": lambda: exprs.modulo(left, right)}[op]()
            return Typed(value.cast(out), out)
        a, b = self.to(x, kind), self.to(y, kind)
        if isinstance(kind, T.LongType):
            value = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: exprs.int_div(a, b), "%": lambda: exprs.modulo(a, b)}[op]()
        else:
            value = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: exprs.float_div(a, b), "%": lambda: F.when(b == 0, F.lit(float("nan"))).otherwise(exprs.modulo(a, b))}[op]()
        return Typed(value, kind)

    def on_case(self, e, scope, found):
        whens = [(self.truth(a, scope, found), self.bind(b, scope, found)) for a, b in e[1]]
        other = self.bind(e[2], scope, found) if e[2] else Typed(F.lit(None), None)
        kind = other.kind
        for _, v in whens:
            kind = common(kind, v.kind)
        out = None
        for a, v in whens:
            out = F.when(a, self.to(v, kind)) if out is None else out.when(a, self.to(v, kind))
        return Typed(out.otherwise(self.to(other, kind)), kind)

    def on_cast(self, e, scope, found):
        if e[3] and e[2] == ("string",) and e[1][0] == "col":
            alias, name, _, _ = scope.find(e[1][1])
            hits = [c for c in scope.columns if c[0] == alias and c[1] == name + SUFFIX]
            if found is not None:
                raise DialectError(f"{name}{SUFFIX} is neither grouped nor in an aggregate")
            return Typed(F.col(q(hits[0][2])) if hits else F.lit(None).cast(STRING), STRING)
        x, kind = self.bind(e[1], scope, found), type_of(e[2])
        if isinstance(kind, T.ArrayType) or isinstance(x.kind, T.ArrayType):
            raise DialectError("lists aren't cast")
        return Typed(x.col.cast(kind) if x.kind is None else exprs.cast(x.col, x.kind, kind), kind)

    def on_items(self, e, scope, found):
        values, kind = [self.bind(x, scope, found) for x in e[1]], None
        for v in values:
            kind = common(kind, v.kind)
        if isinstance(kind, T.ArrayType):
            raise DialectError("a list of lists")
        return Typed(F.array(*[v.col.cast(kind or STRING) for v in values]).cast(T.ArrayType(kind or STRING)), T.ArrayType(kind or STRING))

    def on_lambda(self, e, scope, found):
        raise DialectError("a function stands only in list_map and list_filter")

    def over_list(self, name: str, args: list, scope, found) -> Typed:
        """list_map(xs, x -> expression), list_filter(xs, x -> condition)"""
        xs = self.bind(args[0], scope, found)
        if not isinstance(xs.kind, T.ArrayType) or args[1][0] != "lambda":
            raise DialectError(f"{name} needs a list and a function")
        _, variable, body = args[1]
        around, kinds = dict(self.variables), []

        def f(x: Column) -> Column:
            self.variables = around | {variable: Typed(x, xs.kind.elementType)}
            try:
                out = self.bind(body, scope, found)
            finally:
                self.variables = around
            kinds.append(out.kind or STRING)
            return out.col.cast(kinds[-1])

        if name == "list_map":
            col = F.transform(xs.col, f)
            if isinstance(kinds[-1], T.ArrayType):
                raise DialectError("a list of lists")
            return Typed(col, T.ArrayType(kinds[-1]))
        col = F.filter(xs.col, f)
        if not isinstance(kinds[-1], T.BooleanType):
            raise DialectError("list_filter needs a condition")
        return Typed(col, xs.kind)

    def matched(self, args: list, scope) -> Typed:
        """Whether a text holds a word of the query; score() is by BM25, of statistics read over the table when the statement is bound."""
        if len(args) != 2 or args[1][0] != "str" or scope is None:
            raise DialectError("MATCH needs a column and a literal query")
        self.score, hit = analysis.bm25(scope.df, self.text(args[0], scope, None), args[1][1])
        return Typed(hit, BOOL)

    def on_call(self, e, scope, found):
        _, name, args, _, _ = e
        if name in ("list_map", "list_filter") and len(args) == 2:
            return self.over_list(name, args, scope, found)
        if name == "match":
            return self.matched(args, scope)
        if name == "score" and not args:
            if self.score is None or found is not None:
                raise DialectError("score() needs MATCH in WHERE, without groups")
            return Typed(self.score, FLOAT)
        if name in AGGREGATES:
            raise DialectError(f"aggregate {name} has no place here")
        bind = lambda i: self.bind(args[i], scope, found)
        n = len(args)
        if name in ("lower", "upper") and n == 1:
            return Typed(getattr(F, name)(self.text(args[0], scope, found)), STRING)
        if name in ("length", "char_length") and n == 1:
            return Typed(F.length(self.text(args[0], scope, found)).cast(INT), INT)
        if name in ("substr", "substring") and n in (2, 3):
            return Typed(exprs.substr(self.text(args[0], scope, found), bind(1).col, bind(2).col if n == 3 else None), STRING)
        if name in ("regexp_match", "regexp_matches") and n == 2:
            pattern = bind(1).literal
            if not isinstance(pattern, str):
                raise DialectError(f"{name} needs a literal pattern")
            return Typed(exprs.regexp_match(self.text(args[0], scope, found), pattern), BOOL)
        if name == "unnest":
            raise DialectError("unnest stands only by itself in SELECT")
        if name == "in_network" and n == 2:
            ip, network = bind(0), bind(1).literal
            if not isinstance(ip.kind, T.BinaryType) or not isinstance(network, str):
                raise DialectError("in_network needs an address and a literal network")
            return Typed(exprs.in_network(ip.col, network), BOOL)
        if name == "date_trunc" and n == 2:
            return Typed(exprs.date_trunc(bind(0).literal, bind(1).col), T.TimestampType())
        if name == "date_part" and n == 2:
            return Typed(exprs.extract(bind(0).literal, bind(1).col), INT)
        if name == "time_bucket" and n in (2, 3) and args[0][0] == "interval":
            origin = exprs.ORIGIN_US
            if n == 3:
                origin = int((datetime.datetime.fromisoformat(args[2][1]) - datetime.datetime(1970, 1, 1)).total_seconds() * 1000000)
            return Typed(exprs.time_bucket(exprs.interval_us(args[0][1]), bind(1).col, origin), T.TimestampType())
        if name in ("now", "current_timestamp") and not n:
            return Typed(F.lit(self.context.now), T.TimestampType())
        if name == "coalesce_text" and n == 1 and args[0][0] == "col":
            alias, column, inner, kind = scope.find(args[0][1])
            hits = [c for c in scope.columns if c[0] == alias and c[1] == column + SUFFIX]
            own = exprs.text(F.col(q(inner)), kind)
            return Typed(F.coalesce(own, F.col(q(hits[0][2]))) if hits else own, STRING)
        raise DialectError(f"unknown function: {name}")

    def on_over(self, e, scope, found):
        _, (_, name, args, distinct, where), per, order, frame = e
        if distinct or where is not None:
            raise DialectError("DISTINCT or FILTER with OVER")
        w = Window.partitionBy(*[self.bind(p, scope, found).col for p in per])
        if order:
            w = w.orderBy(*[relational.order(self.bind(k, scope, found).col, d, n) for k, d, n in order])
        if frame:
            w = getattr(w, f"{frame[0]}Between")(frame[1], frame[2])
        numbering = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}
        if name in numbering and not args:
            if not order:
                raise DialectError(f"{name} needs ORDER BY")
            return Typed(numbering[name]().over(w).cast(INT), INT)
        if name == "count" and args == [("star",)]:
            return Typed(F.count(F.lit(1)).over(w), INT)
        if not args:
            raise DialectError(f"{name} without an argument")
        x = self.bind(args[0], scope, found)
        kind = x.kind or STRING
        col = x.col.cast(kind)
        if name in ("lag", "lead"):
            n, default = (self.bind(a, scope, found).literal for a in (*args[1:3], *[("null",)] * (3 - len(args[:3]))))
            if not order:
                raise DialectError(f"{name} needs ORDER BY")
            return Typed(getattr(F, name)(col, 1 if n is None else n, default).over(w), kind)
        if name in ("first_value", "last_value", "min", "max"):
            return Typed(getattr(F, name.removesuffix("_value"))(col).over(w), kind)
        if name == "count":
            return Typed(F.count(col).over(w), INT)
        if name in ("sum", "avg"):
            if not isinstance(kind, NUMBERS):
                raise DialectError(f"{name} needs numbers")
            out = FLOAT if name == "avg" else T.DecimalType(38, kind.scale) if isinstance(kind, T.DecimalType) else kind
            return Typed(getattr(F, name)(col.cast(out)).over(w).cast(out), out)
        raise DialectError(f"unknown window function: {name}")

    # sources

    def source(self, t: tuple | None, ctes: dict) -> Scope:
        if t is None:
            return Scope(self.engine.spark.range(1).select(), [])
        if t[0] in ("join", "nearest"):
            return (self.join if t[0] == "join" else self.nearest)(t, ctes)
        if t[0] == "sub":
            df, alias = self.query(t[1], ctes), t[2]
        elif t[0] == "file":
            df, alias = ingest.files(self.engine.spark, t[1]), t[2]
        else:
            _, name, alias, version = t
            df = self.query(*ctes[name]) if name in ctes else self.engine.table(name, version)
        self.count = getattr(self, "count", 0) + 1
        inner = [f"r{self.count}_{i}" for i in range(len(df.columns))]
        kinds = [narrow(f.dataType) for f in df.schema]
        casts = [F.col(q(c)).cast(k).alias(i) if k != f.dataType else F.col(q(c)).alias(i) for c, i, k, f in zip(df.columns, inner, kinds, df.schema)]
        return Scope(df.select(*casts), [(alias, c, i, k) for c, i, k in zip(df.columns, inner, kinds)])

    def conjuncts(self, e: tuple) -> list[tuple]:
        return self.conjuncts(e[1]) + self.conjuncts(e[2]) if e[0] == "and" else [e]

    def columns_of(self, e) -> list[list[str]]:
        if isinstance(e, tuple) and e and e[0] == "col":
            return [e[1]]
        return [c for x in e if isinstance(x, (tuple, list)) for c in self.columns_of(x)] if isinstance(e, (tuple, list)) else []

    def join(self, t: tuple, ctes: dict) -> Scope:
        _, how, lt, rt, on = t
        left, right = self.source(lt, ctes), self.source(rt, ctes)
        both = Scope(None, left.columns + right.columns)
        if {c[0] for c in left.columns} & {c[0] for c in right.columns}:
            raise DialectError("a table alias is used twice")
        side = lambda e: {both.find(c) in left.columns for c in self.columns_of(e)}
        equal = False
        for c in self.conjuncts(on):
            if c[0] == "cmp" and c[1] == "=" and len(side(c[2])) == len(side(c[3])) == 1 and side(c[2]) != side(c[3]):
                equal = True
            elif how == "left" and True in side(c):
                raise DialectError("LEFT JOIN's other conditions must be of the right side")
        if not equal:
            raise DialectError("a join needs an equality between its sides")
        return Scope(left.df.join(right.df, self.truth(on, both), how), both.columns)

    def nearest(self, t: tuple, ctes: dict) -> Scope:
        """ON equalities AND one comparison of times: the left's is at or after the right's."""
        _, how, lt, rt, on = t
        left, right = self.source(lt, ctes), self.source(rt, ctes)
        both = Scope(None, left.columns + right.columns)
        if {c[0] for c in left.columns} & {c[0] for c in right.columns}:
            raise DialectError("a table alias is used twice")
        keys, times = [], []
        for c in self.conjuncts(on):
            if c[0] != "cmp" or c[1] not in ("=", ">=", "<=") or c[2][0] != "col" or c[3][0] != "col":
                raise DialectError("NEAREST JOIN takes comparisons of columns")
            pair, op = [both.find(c[2][1]), both.find(c[3][1])], c[1]
            if pair[0] not in left.columns:
                pair, op = pair[::-1], {"=": "=", ">=": "<=", "<=": ">="}[op]
            if pair[0] not in left.columns or pair[1] not in right.columns or op == "<=":
                raise DialectError("NEAREST JOIN needs a time of the left side at or after one of the right side")
            (keys if op == "=" else times).append(pair)
        if not keys or len(times) != 1:
            raise DialectError("NEAREST JOIN needs an equality and one comparison of times")
        names = [f"k{i}__" for i in range(len(keys))]
        kinds = [common(a[3], b[3]) for a, b in keys]
        ends = common(*[x[3] for x in times[0]])
        one = left.df.select("*", *[F.col(a[2]).cast(k).alias(n) for (a, _), k, n in zip(keys, kinds, names)], F.col(times[0][0][2]).cast(ends).alias("t__"))
        two = right.df.select("*", *[F.col(b[2]).cast(k).alias(n) for (_, b), k, n in zip(keys, kinds, names)], F.col(times[0][1][2]).cast(ends).alias("u__"))
        out = relational.nearest_join(one, two, names, "t__", "u__", [c[2] for c in right.columns], how)
        return Scope(out.drop(*names, "t__"), both.columns)

    # queries

    def query(self, e: tuple, outer: dict | None = None) -> DataFrame:
        _, ctes, parts, order, limit, offset, per = e
        known = dict(outer or {})
        for name, sub in ctes:
            known[name] = (sub, dict(known))
        if len(parts) == 1 and parts[0][0] == "core":
            return self.core(parts[0], known, order, limit, offset, per)
        frames = [self.query(p[1], known) if p[0] == "nested" else self.core(p, known, [], None, 0, None) for p in parts]
        df = self.union(frames)
        scope = Scope(df, [("", c, c, narrow(f.dataType)) for c, f in zip(df.columns, df.schema)])
        keys = [relational.order(self.key(k, scope, df.columns), d, n) for k, d, n in order]
        return relational.top(df, keys, limit, offset)

    def key(self, e: tuple, scope: Scope, names: list[str]) -> Column:
        if e[0] == "num" and e[1].isdigit():
            if not 1 <= int(e[1]) <= len(names):
                raise DialectError(f"no column {e[1]}")
            return F.col(q(names[int(e[1]) - 1]))
        return self.bind(e, scope).col

    def union(self, frames: list[DataFrame]) -> DataFrame:
        names, kinds = frames[0].columns, [narrow(f.dataType) if not isinstance(f.dataType, T.NullType) else None for f in frames[0].schema]
        for f in frames[1:]:
            if len(f.columns) != len(names):
                raise DialectError("UNION ALL of different numbers of columns")
            kinds = [common(a, narrow(b.dataType) if not isinstance(b.dataType, T.NullType) else None) for a, b in zip(kinds, f.schema)]
        cast = [f.select(*[F.col(q(c)).cast(k or STRING).alias(n) for c, k, n in zip(f.columns, kinds, names)]) for f in frames]
        out = cast[0]
        for f in cast[1:]:
            out = out.union(f)
        return out

    def aggregates(self, e, out: dict) -> None:
        if isinstance(e, tuple) and e and e[0] == "over":
            self.aggregates([e[1][2], *e[2:4]], out)
        elif isinstance(e, tuple) and e and e[0] == "call" and e[1] in AGGREGATES:
            out[repr(e)] = e
        elif isinstance(e, (tuple, list)):
            for x in e:
                self.aggregates(x, out)

    @staticmethod
    def title(e: tuple) -> str:
        return e[1][-1] if e[0] == "col" else e[1] if e[0] == "call" else "?column?"

    def core(self, e: tuple, ctes: dict, order: list, limit, offset, per) -> DataFrame:
        _, distinct, items, source, where, group, having = e
        scope = self.source(source, ctes)
        self.score = None
        if where is not None:
            scope.df = scope.df.filter(self.truth(where, scope))
        shown: list[tuple[tuple, str]] = []
        for it in items:
            if it[0] == "item":
                shown.append((it[1], it[2] or self.title(it[1])))
                continue
            if source is None:
                raise DialectError("* without FROM")
            under = lambda name, path: name == path or path.endswith(".*") and name.startswith(path[:-1])
            stars = [c for c in scope.columns if it[1] in (None, c[0]) or under(c[1], f"{it[1]}.*") or under(f"{c[0]}.{c[1]}", f"{it[1]}.*")]
            stars = [c for c in stars if not any(under(c[1], x) for x in it[2])]
            if not stars:
                raise DialectError("* without columns")
            shown += [(("col", [c[0], c[1]]), c[1]) for c in stars]
        aliases = {n: x for x, n in shown}
        filling = None
        if isinstance(group, tuple):
            _, filling, group = group
        calls: dict[str, tuple] = {}
        self.aggregates([x for x, _ in shown] + [o[0] for o in order] + [having], calls)
        if group == "all":
            group = [x for x, _ in shown if not (lambda d: self.aggregates(x, d) or d)({})]
        found, df = None, scope.df
        if calls or group:
            keys = [self.grouping(g, shown, aliases, scope) for g in group or []]
            df, found = self.grouped(scope, keys, list(calls.values()))
            if filling:
                df = self.filled(df, keys, [found[repr(c)] for c in calls.values()], filling)
            if having is not None:
                df = df.filter(self.truth(having, scope, found))
        elif having is not None:
            raise DialectError("HAVING without groups or aggregates")
        values, lists = [], []
        for x, _ in shown:
            if x[0] == "call" and x[1] == "unnest" and len(x[2]) == 1:
                xs = self.bind(x[2][0], scope, found)
                if not isinstance(xs.kind, T.ArrayType) or lists or distinct or per:
                    raise DialectError("unnest needs a list, once in a SELECT")
                lists.append(xs)
                df = df.withColumn("u__", F.explode(xs.col))
                values.append(Typed(F.col("u__"), xs.kind.elementType))
            else:
                values.append(self.bind(x, scope, found))
        names = self.unique([n for _, n in shown])
        inner = [f"o{i}" for i in range(len(names))]
        result = [v.col.cast(STRING).alias(i) if v.kind is None else v.col.alias(i) for v, i in zip(values, inner)]
        sort = []
        for k, desc, nulls in order:
            if k[0] == "num" and k[1].isdigit():
                if not 1 <= int(k[1]) <= len(names):
                    raise DialectError(f"no column {k[1]}")
                c = F.col(inner[int(k[1]) - 1])
            elif k[0] == "col" and len(k[1]) == 1 and k[1][0] in names:
                c = F.col(inner[names.index(k[1][0])])
            elif distinct:
                raise DialectError("ORDER BY of DISTINCT must be selected")
            else:
                c = self.bind(k, scope, found).col
            sort.append(relational.order(c, desc, nulls))
        if distinct:
            out = df.select(*result).distinct()
        else:
            out = df.select("*", *result)
        if per:
            groups = [F.col(inner[names.index(p[1][0])]) if p[0] == "col" and p[1][-1] in names else self.bind(p, scope, found).col for p in per]
            out = out.withColumns({f"p{i}": g for i, g in enumerate(groups)})
            out = relational.limit_per(out, limit, [f"p{i}" for i in range(len(groups))], sort or [F.lit(0)])
            limit = None
        out = relational.top(out, sort, limit, offset)
        return out.select(*[F.col(i).alias(n) for i, n in zip(inner, names)])

    @staticmethod
    def unique(names: list[str]) -> list[str]:
        if twice := [n for i, n in enumerate(names) if n in names[:i] and n != "?column?"]:
            raise DialectError(f"two columns named {twice[0]}")
        return [n if n not in names[:i] else f"{n}_{i}" for i, n in enumerate(names)]

    def grouping(self, g: tuple, shown, aliases, scope: Scope) -> tuple:
        if g[0] == "num" and g[1].isdigit():
            if not 1 <= int(g[1]) <= len(shown):
                raise DialectError(f"no column {g[1]}")
            return shown[int(g[1]) - 1][0]
        if g[0] == "col" and len(g[1]) == 1 and g[1][0] in aliases and not any(c[1] == g[1][0] for c in scope.columns):
            return aliases[g[1][0]]
        return g

    def grouped(self, scope: Scope, keys: list[tuple], calls: list[tuple]) -> tuple[DataFrame, dict]:
        """The frame of groups and what stands in it: keys and aggregates, by their tuples' text."""
        found, names = {}, [f"g{i}" for i in range(len(keys))]
        bound = [self.bind(k, scope) for k in keys]
        df = scope.df.withColumns({n: b.col for n, b in zip(names, bound)}) if keys else scope.df
        single, frames = [], {}
        for i, call in enumerate(calls):
            name, kind = f"a{i}", None
            value, frame, kind = self.aggregate(call, scope, df, names)
            if frame is None:
                single.append(value.alias(name))
            else:
                frames[name] = frame
            found[repr(call)] = Typed(F.col(name), kind)
        out = df.groupBy(*names).agg(*(single or [F.count(F.lit(1)).alias("a_")]))
        out = aggs.joined(out, names, frames)
        for k, n, b in zip(keys, names, bound):
            found[repr(k)] = Typed(F.col(n), b.kind)
            if k[0] == "col":
                a, c, *_ = scope.find(k[1])
                found[repr(("col", [c]))] = found[repr(("col", [a, c]))] = found[repr(k)]
        return out, found

    @staticmethod
    def filled(df: DataFrame, keys: list[tuple], aggregates: list[Typed], how: str) -> DataFrame:
        """The groups with rows for the buckets of time that lack one, between the first and the last of the other keys' values."""
        times = [i for i, k in enumerate(keys) if k[0] == "call" and k[1] == "time_bucket"]
        if len(times) != 1:
            raise DialectError("FILL needs one time_bucket among the groups")
        if not all(isinstance(a.kind, NUMBERS) for a in aggregates):
            raise DialectError("FILL needs aggregates that are numbers")
        names = [f"a{i}" for i in range(len(aggregates))]
        width = exprs.interval_us(keys[times[0]][2][0][1])
        others = [f"g{i}" for i in range(len(keys)) if i not in times]
        if how == "linear":
            for a in aggregates:
                a.kind = FLOAT
        return relational.gap_filled(df, f"g{times[0]}", width, names, others, how)

    def aggregate(self, call: tuple, scope: Scope, df: DataFrame, keys: list[str]) -> tuple[Column | None, DataFrame | None, T.DataType]:
        _, name, args, distinct, where = call
        cond = None if where is None else self.truth(where, scope)
        pick = lambda c: c if cond is None else F.when(cond, c)
        if distinct and name != "count":
            raise DialectError(f"{name}(DISTINCT)")
        if name == "count" and args == [("star",)]:
            return F.count(pick(F.lit(1))), None, INT
        if not args:
            raise DialectError(f"{name} without an argument")
        x = self.bind(args[0], scope)
        kind = x.kind or STRING
        col = x.col.cast(kind)
        number = isinstance(kind, NUMBERS)
        if isinstance(kind, T.ArrayType) and (name in ("min", "max", "histogram", "top_k") or distinct):
            raise DialectError(f"{name} of a list")
        if name == "count":
            return (F.count_distinct(pick(col)) if distinct else F.count(pick(col))), None, INT
        if name in ("sum", "avg"):
            if not number:
                raise DialectError(f"{name} needs numbers")
            return (aggs.total if name == "sum" else aggs.mean)(pick(col), kind), None, FLOAT if name == "avg" else T.DecimalType(38, kind.scale) if isinstance(kind, T.DecimalType) else kind
        if name in ("min", "max"):
            return getattr(F, name)(pick(col)), None, kind
        if name in ("arg_min", "min_by", "arg_max", "max_by"):
            by = self.bind(args[1], scope).col
            return (F.min_by if "min" in name else F.max_by)(col, pick(by)), None, kind
        if name in ("list", "list_agg", "array_agg"):
            return aggs.list_agg(col, cond), None, T.ArrayType(kind)
        if name == "approx_count_distinct":
            return aggs.approx_count_distinct(pick(col)), None, INT
        rows = df if cond is None else df.filter(cond)
        if name == "histogram":
            return None, aggs.histogram(rows, keys, col), STRING
        given = self.bind(args[1], scope).literal if len(args) == 2 else None
        if name == "top_k":
            if not isinstance(given, int) or given <= 0:
                raise DialectError("top_k needs a literal k > 0")
            return None, aggs.top_k(rows, keys, col, given), T.ArrayType(kind)
        if given is None or not 0 <= given <= 1:
            raise DialectError(f"{name} needs a literal between 0 and 1")
        if name == "approx_quantile":
            if not number:
                raise DialectError("approx_quantile needs numbers")
            return None, aggs.approx_quantile(rows, keys, col, float(given)), FLOAT
        return None, aggs.quantile(rows, keys, col, float(given)), kind


@dataclass
class Result:
    rows: DataFrame | None = None
    count: int | None = None
    warnings: list[str] = field(default_factory=list)


class Engine:
    """Statements over a store's tables, and over frames registered by name."""

    def __init__(self, spark: SparkSession, store: Store | str | None = None):
        self.spark, self.frames = spark, {}
        self.store = Store(spark, store) if isinstance(store, str) else store

    def register(self, name: str, df: DataFrame) -> None:
        self.frames[name] = df

    def table(self, name: str, version: int | None = None) -> DataFrame:
        name = name.removeprefix("main.")
        if name in self.frames:
            return self.frames[name]
        if self.store is None:
            raise DialectError(f"no such table: {name}")
        return self.store.read(name, version)

    def execute(self, sql: str, now: datetime.datetime | None = None) -> Result:
        """Runs the statements in order and returns the last one's result. Names are told apart by case meanwhile, whatever the
        session does."""
        out, was = Result(), self.spark.conf.get("spark.sql.caseSensitive")
        self.spark.conf.set("spark.sql.caseSensitive", "true")
        try:
            for s in parse(sql):
                context = Context(**({"now": now} if now else {}))
                out = getattr(self, "do_" + s[0].replace(" ", "_"))(s, Binder(self, context))
                out.warnings = context.warnings
        finally:
            self.spark.conf.set("spark.sql.caseSensitive", was)
        return out

    def sql(self, sql: str) -> DataFrame:
        return self.execute(sql).rows

    def do_query(self, s, b):
        return Result(b.query(s[1]))

    def do_explain(self, s, b):
        plan = b.query(s[1])._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return Result(self.spark.createDataFrame([(line,) for line in plan.split("\n")], "plan string"))

    def do_explain_alter(self, s, b):
        """What a change would touch, before it is made."""
        kind, name, *rest = s[1]
        name = name.removeprefix("main.")
        names = self.store.schema(name).names
        for c in rest[0] if kind == "order by" else rest[:1] if kind != "add" else []:
            if c not in names:
                raise DialectError(f"no such column: {c}")
        cost = self.store.explain_alter(name, kind == "order by")
        return Result(self.spark.createDataFrame([(kind, *cost.values())], "change string, " + ", ".join(f"{k} long" for k in cost)))

    def do_begin(self, s, b):
        self.store.begin()
        return Result()

    def do_commit(self, s, b):
        self.store.commit()
        return Result()

    def do_rollback(self, s, b):
        self.store.rollback()
        return Result()

    def do_backup(self, s, b):
        self.store.backup(s[1])
        return Result()

    def do_show(self, s, b):
        """The statement that would create the table."""
        name = s[1].removeprefix("main.")
        spec = self.store.table(name)["spec"]
        quote = lambda c: '"' + c.replace('"', '""') + '"'
        columns = ", ".join(f"{quote(f.name)} {spelled(f.dataType)}" for f in self.store.schema(name))
        listed = lambda cs: "(" + ", ".join(map(quote, cs)) + ")"
        parts = [f" ENGINE = {spec['engine']}"]
        parts += [f" KEY {listed(spec['key'])}"] if spec.get("key") else []
        parts += [f" VERSION {listed([spec['version']])}"] if spec.get("version") else []
        parts += [f" ORDER BY {listed(spec['order_by'])}"] if spec.get("order_by") else []
        if by := spec.get("partition_by"):
            parts.append(f" PARTITION BY {quote(by[0])}" + (f"('{by[1]}')" if len(by) > 1 else ""))
        parts += [f" TTL {quote(spec['ttl'][0])} + INTERVAL '{spec['ttl'][1]}'"] if spec.get("ttl") else []
        return Result(self.spark.createDataFrame([(f"CREATE TABLE {quote(name)} ({columns}){''.join(parts)}",)], "statement string"))

    def do_create_as(self, s, b):
        name = s[1].removeprefix("main.")
        df = b.query(s[2])
        if name in self.store.snapshot()["tables"] and s[3]:
            return Result()
        self.store.create(name, T.StructType([T.StructField(f.name, narrow(f.dataType)) for f in df.schema]), s[3])
        return Result(count=self.store.insert(name, df))

    def do_create_like(self, s, b):
        of = s[2].removeprefix("main.")
        self.store.create(s[1].removeprefix("main."), self.store.schema(of), s[3], **self.store.table(of)["spec"])
        return Result()

    def do_order_by(self, s, b):
        self.store.order_by(s[1].removeprefix("main."), s[2])
        return Result()

    def do_update(self, s, b):
        _, name, sets, where = s
        name = name.removeprefix("main.")
        read, schema = self.store.table(name), self.store.schema(name)
        if read["spec"]["engine"] != "append":
            raise DialectError(f"UPDATE of an engine {read['spec']['engine']}; insert the new row")
        if len({c for c, _ in sets}) != len(sets):
            raise DialectError("a column is named twice")
        scope = b.source(("table", name, name.split(".")[-1], None), {})
        hit = F.lit(True) if where is None else F.coalesce(b.truth(where, scope), F.lit(False))
        new: dict[str, Column] = {}
        for c, e in sets:
            if c not in schema.names:
                raise DialectError(f"no such column: {c}")
            v = b.bind(e, scope)
            new |= zip((c, c + SUFFIX), self.fit(v.col, v.kind, c, schema))
        ids = {f["name"]: f"f{f['id']}" for f in read["fields"]}
        rows = scope.df.select(*[(F.when(hit, new[n]).otherwise(F.col(i)) if n in new else F.col(i)).cast(schema[n].dataType).alias(ids[n]) for _, n, i, _ in scope.columns])
        count = scope.df.filter(hit).count()
        if count:
            self.store.replace(name, rows, read)
        return Result(count=count)

    def do_copy_to(self, s, b):
        """Writes a folder of part files."""
        _, query, path, options = s
        form = options.get("format") or ("ndjson" if path.endswith((".ndjson", ".jsonl", ".json")) else "parquet" if path.endswith(".parquet") else "csv")
        df = b.query(query)
        if form == "csv":
            flat = df.select(*[exprs.text(F.col(q(f.name)), narrow(f.dataType)).alias(f.name) for f in df.schema])
            flat.write.option("header", options.get("header", "true")).option("sep", options.get("delimiter", ",")).option("escape", '"').option("nullValue", "").option("emptyValue", '""').csv(path)
        elif form in ("ndjson", "parquet"):
            getattr(df.write, "json" if form == "ndjson" else form)(path)
        else:
            raise DialectError(f"unknown format: {form}")
        return Result()

    def do_schema(self, s, b):
        return Result()

    def do_create(self, s, b):
        _, name, columns, spec, quiet = s
        self.store.create(name.removeprefix("main."), T.StructType([T.StructField(c, type_of(k)) for c, k in columns]), quiet, **spec)
        return Result()

    def do_drop(self, s, b):
        self.store.drop(s[1].removeprefix("main."), s[2])
        return Result()

    def do_undrop(self, s, b):
        self.store.undrop(s[1])
        return Result()

    def do_truncate(self, s, b):
        self.store.truncate(s[1])
        return Result()

    def do_add(self, s, b):
        self.store.add_column(s[1], s[2], type_of(s[3]))
        return Result()

    def do_drop_column(self, s, b):
        self.store.drop_column(s[1], s[2])
        return Result()

    def do_rename(self, s, b):
        self.store.rename_column(s[1], s[2], s[3])
        return Result()

    def do_insert(self, s, b):
        _, name, columns, rows, query = s
        name = name.removeprefix("main.")
        schema = self.store.schema(name)
        columns = columns or ingest.data_columns(schema)
        if len(set(columns)) != len(columns):
            raise DialectError("a column is named twice")
        if unknown := [c for c in columns if c not in schema.names]:
            raise DialectError(f"no such column: {unknown[0]}")
        if query is not None:
            df = b.query(query)
            if len(df.columns) != len(columns):
                raise DialectError("INSERT of another number of columns")
            fitted = [self.fit(F.col(q(c)), narrow(f.dataType), n, schema) for c, f, n in zip(df.columns, df.schema, columns)]
        else:
            if any(len(r) != len(columns) for r in rows):
                raise DialectError("INSERT of another number of values")
            lines = []
            for r in rows:
                values = [b.bind(v, None) for v in r]
                lines.append(F.struct(*[c for v, n in zip(values, columns) for c in self.fit(v.col, v.kind, n, schema)]))
            df = self.spark.range(1).select(F.explode(F.array(*lines)).alias("x")).select("x.*")
            return Result(count=self.store.insert(name, df))
        return Result(count=self.store.insert(name, df.select(*[c for p in fitted for c in p])))

    @staticmethod
    def fit(col: Column, kind: T.DataType | None, name: str, schema: T.StructType) -> list[Column]:
        """A value that fits its column stays, else its text goes to the companion, else it is an error."""
        want, companion = schema[name].dataType, name + SUFFIX
        if kind is None or kind == want or isinstance(kind, T.NullType):
            return [col.cast(want).alias(name)] + ([F.lit(None).cast(STRING).alias(companion)] if companion in schema.names else [])
        if isinstance(kind, T.StringType):
            value = exprs.parsed(col, want)
        elif isinstance(want, T.StringType):
            value = exprs.text(col, kind)
        else:
            value = col.try_cast(want)
            if isinstance(kind, NUMBERS) and isinstance(want, NUMBERS):
                value = F.when(value.cast("decimal(38,9)") == col.try_cast("decimal(38,9)"), value) if not isinstance(want, T.DoubleType) else value
        wrong = col.isNotNull() & value.isNull()
        if companion in schema.names:
            return [value.alias(name), F.when(wrong, exprs.text(col, kind)).alias(companion)]
        return [F.when(wrong, F.raise_error(F.concat(F.lit(f"column {name}: doesn't fit: "), exprs.text(col, kind))).cast(want)).otherwise(value).alias(name)]

    def do_delete(self, s, b):
        where = []
        for c in b.conjuncts(s[2]) if s[2] is not None else []:
            if c[0] != "cmp" or c[2][0] != "col":
                raise DialectError("DELETE takes comparisons of a column with a value, joined by AND")
            v = b.bind(c[3], None)
            if v.kind is None:
                raise DialectError("delete compares with NULL")
            value = v.literal if v.literal is not None else self.spark.range(1).select(v.col.cast(STRING)).first()[0]
            where.append((c[2][1][-1], c[1], value))
        return Result(count=self.store.delete(s[1].removeprefix("main."), where))

    def do_copy(self, s, b):
        _, name, columns, path, options = s
        form = options.get("format") or ("ndjson" if path.endswith((".ndjson", ".jsonl", ".json")) else "csv")
        schema = self.store.schema(name)
        if form == "csv":
            df = ingest.read_csv(self.spark, path, schema, options.get("header", "true") == "true", options.get("delimiter", ","), columns)
        elif form == "ndjson":
            df = ingest.read_ndjson(self.spark, path, schema)
        else:
            raise DialectError(f"unknown format: {form}")
        return Result(count=self.store.insert(name, df))
