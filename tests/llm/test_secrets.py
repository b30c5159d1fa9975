"""The sample that the models learn from, and what they find of forms that nobody has named."""

import math
import random
import re

from millrace.llm import secrets
from pyspark.sql import functions as F


def test_copies_take_no_place_in_the_sample(spark):
    once = spark.createDataFrame([(f"the password = value{i:03}abcdefghijk of understanding{i:03}",) for i in range(30)], "text string")
    hot = once.orderBy(F.xxhash64("text")).limit(1).crossJoin(spark.range(50)).select("text")
    a, b = (sorted(tuple(r) for r in secrets.labelled_tokens(x, sample=10).collect()) for x in (once, once.union(hot)))
    assert a == b and sum(s for _, s in a) == 10
    assert secrets.labelled_tokens(once.limit(0)).count() == 0


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def words(r, n):
    parts = "the ing tion er on at es re ha de an ou st of is con fi gu ra able inter nation al iz under stand value path user name".split()
    return ["".join(r.choices(parts, k=r.randint(2, 7))) for _ in range(n)]


def test_recall_and_precision_on_forms_that_are_not_named(spark):
    """Models of hex values and words alone; keys of other alphabets, and other words, are held out."""
    r = random.Random(8)
    hexes = ["".join(r.choices("0123456789abcdef", k=40)) for _ in range(200)]
    texts = [f"token = {h} " + " ".join(words(r, 30)) for h in hexes]
    model = secrets.fitted(secrets.labelled_tokens(spark.createDataFrame([(t,) for t in texts], "text string")))
    keys = ["".join(r.choices(LETTERS, k=r.randint(16, 48))) for _ in range(300)] + ["ghp_" + "".join(r.choices(LETTERS, k=36)) for _ in range(50)]
    plain = [w for w in words(r, 6000) if len(w) >= 16] + ["_".join(words(r, 3)) for _ in range(300)] + ["A-Long-Heading-Of-Words"]
    df = spark.createDataFrame([(i, f"see {k} there") for i, k in enumerate([*keys, *plain])], "doc_id long, text string")
    out = {x.doc_id: x.s for x in secrets.found(df, model).select("doc_id", secrets.written(F.col("all_spans")).alias("s")).collect()}
    hit = [i for i in range(len(keys)) if out[i] == f"random:4:{4 + len(keys[i])}"]
    false = [i for i in range(len(keys), len(out)) if out[i]]
    assert len(plain) > 500 and len(hit) >= 0.92 * len(keys) and len(false) <= 0.005 * len(plain)


def test_ratio_by_its_formula(spark):
    rows = [("ab12", True), ("a1b2c3", True), ("understand", False), ("standing", False), ("x", False)]
    model = secrets.fitted(spark.createDataFrame(rows, "token string, is_secret boolean"))

    def p(secret, a, b):
        pairs = [(t[i], t[i + 1]) for t, s in rows if s == secret for i in range(len(t) - 1)]
        share = (sum(y == b for _, y in pairs) + 0.5) / (len(pairs) + 64)
        return (pairs.count((a, b)) + 8 * share) / (sum(x == a for x, _ in pairs) + 8)

    for a in "abu1xz":
        for b in "ab2ndq":
            assert abs(model[ord(a) * 128 + ord(b)] - math.log(p(True, a, b) / p(False, a, b))) < 1e-12
    token = "a1understand2"
    want = sum(math.log(p(True, a, b) / p(False, a, b)) for a, b in zip(token, token[1:]))
    assert abs(spark.range(1).select(secrets.ratio(F.lit(token), model)).first()[0] - want) < 0.01


def test_many_matches_in_a_very_long_text(spark):
    r = random.Random(1)
    text = " ".join(r.choice(["password=abcdefgh12", "é𝒳 some words", "deadbeef" * 5, "secret: short"]) for _ in range(3000))
    want = []
    for rank, (kind, pattern, least, group, chars) in enumerate(secrets.FORMS):
        want += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least and len(m[group]) >= chars]
    df = spark.createDataFrame([(1, text, 5)], "doc_id long, text string, ALL_spans int")
    out = secrets.found(df, secrets.fitted(secrets.labelled_tokens(df)))
    assert out.columns == ["doc_id", "text", "base_spans", "all_spans"]
    assert out.select(secrets.written(F.col("base_spans"))).first()[0] == ",".join(f"{k}:{a}:{z}" for a, _, k, z in sorted(want))
    empty = df.limit(0)
    assert secrets.found(empty, secrets.fitted(secrets.labelled_tokens(empty))).count() == 0
