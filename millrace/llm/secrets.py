"""Secrets in texts: fixed forms, and strings that look random. DataFrame functions only.

Two character Markov models, of random strings and of ordinary identifiers, are trained from labelled samples; a long
token is reported when its log-likelihood ratio favours the random one by more than ordinary tokens that the models haven't
seen do. Fixed forms are found by pattern and stay.

Places are in code points, ends exclusive. Defined results: null texts are empty and have no spans; a token that touches a
span of a fixed form isn't reported again; equal texts get equal spans; a very long text of many matches is gone through in
groups of GROUP of them. Extra columns pass through (of the same name as a result: replaced).
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, others, quoted

#: The forms, in the order of kinds at one place. Each is (kind, pattern, whole match at least, group, its characters at least).
FORMS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 0, 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 16, 0, 0),
    ("hex", r"[0-9a-f]{32,}", 32, 0, 0),  # the maximal runs of 32 or more
]
#: Tokens that the models judge.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+"  # whole runs: the search doesn't start inside one
#: Natural-log likelihood ratio from which a token is reported, in all and for each character: odds of 150 to 1 or more. Models of
#: the tables give ordinary tokens of scale 0.1 at most 0.9 (those held out in tests: below 5), 94 % of random strings of 16 to
#: 48 letters and digits more, though hex values are all the random strings that they have seen.
LEAST_RATIO, LEAST_EACH = 5.0, 0.25
#: Matches whose places are found together: arrays grow by copying, so a text's matches are not one array from the start.
GROUP = 256
#: Texts with and without matches to learn from, at most.
SAMPLE = 2000
SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def places(text: Column, pattern: str, kind: str, rank: int, least: int = 0, group: int = 0, group_least: int = 0) -> Column:
    """The leftmost non-overlapping matches as spans. The pieces between matches and the matches' lengths give the places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    lengths = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.greatest(F.size(found), F.lit(1))), lambda p: F.length(p))
    both = F.arrays_zip(F.transform(found, lambda m: F.length(m)).alias("m"), F.transform(groups, lambda g: F.length(g)).alias("g"), lengths.alias("p"))
    empty = F.array().cast(SPAN)
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(both) - 1) / GROUP).cast("int")), lambda i: F.slice(both, i * GROUP + 1, F.lit(GROUP)))
    long = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), lambda acc, x: acc + x["p"] + F.coalesce(x["m"], F.lit(0))))
    begin = F.aggregate(
        long, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
        lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")), lambda acc: acc["all"],
    )

    def add(acc, x):
        start = acc["at"] + x["p"]
        end = start + F.coalesce(x["m"], F.lit(0))
        good = (x["m"] >= least) & (x["g"] >= group_least)
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).cast(SPAN).alias("spans"))

    def spans(part, at):
        return F.aggregate(part, F.struct(at.alias("at"), empty.alias("spans")), add, lambda acc: acc["spans"])

    return F.flatten(F.zip_with(parts, begin, spans))


def hints(text: Column) -> dict[str, Column]:
    """By form: whether the text can have a match. Plain searches first, as most texts have none."""
    named = text.rlike(r"(?i:password|passwd|secret|token|api_?key)[\x22']?\x20*[:=]")
    return {"assign": (text.contains("=") | text.contains(":")) & named, "access": text.contains("AKIA"), "hex": text.rlike(r"(?<![0-9a-f])[0-9a-f]{32}")}


def fixed_spans(text: Column) -> Column:
    none, can = F.array().cast(SPAN), hints(text)
    return F.array_sort(F.concat(*[F.when(can[kind], places(text, p, kind, i, least, group, chars)).otherwise(none) for i, (kind, p, least, group, chars) in enumerate(FORMS)]))


def fitted(labelled: DataFrame, token: str = "token", secret: str = "is_secret") -> list[float]:
    """The log ratio of P(next | character) in random strings and in identifiers, at 128 * character + next. Counts of at most 2 * 128 * 128 pairs come to the driver."""
    pair = F.expr(f"explode(transform(sequence(1, length({quoted(token)}) - 1), i -> struct(ascii(substring({quoted(token)}, i, 1)) as a, ascii(substring({quoted(token)}, i + 1, 1)) as b)))")
    rows = labelled.filter(F.length(quoted(token)) > 1).select(F.col(quoted(secret)).alias("s"), pair.alias("x")).filter("x.a < 128 and x.b < 128")
    seen = {(bool(r.s), r.a, r.b): r.n for r in rows.groupBy("s", "x.a", "x.b").agg(F.count(F.lit(1)).alias("n")).collect()}
    of, at, every = Counter(), Counter(), Counter()
    for (s, a, b), n in seen.items():
        of[s, a] += n
        at[s, b] += n
        every[s] += n

    def p(s, a, b):  # what isn't seen after a character follows the characters' own frequencies
        return (seen.get((s, a, b), 0) + 8 * (at[s, b] + 0.5) / (every[s] + 64)) / (of[s, a] + 8)

    return [math.log(p(True, a, b) / p(False, a, b)) for a in range(128) for b in range(128)]


def ratio(token: Column, model: list[float]) -> Column:
    table = F.from_json(F.lit("[" + ",".join(f"{x:.4f}" for x in model) + "]"), "array<double>")
    letter = lambda i: F.ascii(F.substring(token, i, F.lit(1)))
    return F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0), lambda acc, i: acc + F.element_at(table, letter(i) * 128 + letter(i + 1) + 1))


def labelled_tokens(df: DataFrame, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(token, is_secret) from different texts of the smallest hashes: values that fixed forms name, and other tokens of eight characters or more."""
    texts = df.select(F.coalesce(F.col(quoted(text)), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    some = reduce(Column.__or__, hints(F.col("t")).values())

    def different(rows: DataFrame) -> DataFrame:  # the hashes alone are ranked, then copies of the texts they stand for go
        most = rows.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
        return rows.filter(F.col("h") <= F.lit(most).cast("long")).select("h", "t").distinct()

    with_, without = different(texts.filter(some)), different(texts)
    values = [F.regexp_extract_all("t", F.lit(p), F.lit(group)) for _, p, _, group, _ in FORMS]
    secret = with_.select(F.explode(F.concat(*values)).alias("token")).filter(F.length("token") >= 16).withColumn("is_secret", F.lit(True))
    rest = F.col("t")
    for _, p, *_ in FORMS:
        rest = F.regexp_replace(rest, p, " ")
    plain = without.select(F.explode(F.regexp_extract_all(rest, F.lit("[A-Za-z0-9+/_-]{8,}"), F.lit(0))).alias("token")).withColumn("is_secret", F.lit(False))
    return secret.union(plain)


def found(df: DataFrame, model: list[float], text: str = "text", base: str = "base_spans", spans: str = "all_spans") -> DataFrame:
    """`df` with the fixed forms' spans and all spans (arrays of start, rank, kind, end in that order)."""
    (t,) = fresh(df, "searched_text")
    out = df.withColumn(t, F.coalesce(F.col(quoted(text)), F.lit("")))
    out = out.select(*map(quoted, others(out, (base, spans))), fixed_spans(F.col(t)).alias(base))

    def scored(token):
        score = ratio(token, model)
        return (score >= LEAST_RATIO) & (score >= LEAST_EACH * F.length(token))

    def random(s):
        free = ~F.exists(F.col(base), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return free & scored(F.substring(F.col(t), s["start"] + 1, s["end"] - s["start"]))

    # one scan gives the tokens; only texts with one that is reported are gone through for the places
    some = F.exists(F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0)), scored)
    tokens = F.when(some, F.filter(places(F.col(t), TOKEN, "random", len(FORMS)), random)).otherwise(F.array().cast(SPAN))
    (more,) = fresh(out, "token_spans")
    out = out.withColumn(more, tokens).withColumn(spans, F.array_sort(F.concat(F.col(base), F.col(more))))
    return out.drop(t, more)


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each span, or spans that overlap, replaced by the mark."""

    def step(acc, s):
        cut = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        new = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(new, cut).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))
