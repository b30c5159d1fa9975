import random
from collections import Counter

import numpy as np

from millrace.llm import near_dedup as N


def shingles(text):
    w = text.split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return sum((a & b).values()) / max(sum((a | b).values()), 1)


def brute(texts):
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] or jaccard(texts[i], texts[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def family(r, words, n, edits):
    base = r.choices(words, k=r.randint(60, 150))
    out = [" ".join(base)]
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = r.choice(words)
        out.append(" ".join(w))
    return out


def test_signatures_estimate_weighted_similarity():
    r = random.Random(5)
    words = [f"w{i}" for i in range(50)]
    a = " ".join(r.choices(words, k=300))
    b = " ".join(a.split()[:260] + r.choices(words, k=30)) + " x y z x y z x y z x y z"
    doc, cell = N.cells([a.encode(), b.encode(), b""])
    s = N.signatures(doc, cell, 3, k=4000)
    assert abs((s[0] == s[1]).mean() - jaccard(a, b)) < 0.03
    assert not s[2].any()
    assert N.similarity(cell[doc == 0], cell[doc == 1]) == jaccard(a, b)


def test_classes_as_by_all_pairs(spark, docs):
    r = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    texts = [t for _ in range(8) for t in family(r, words, r.randint(0, 12), 4)] + ["", "a b", "a b", "a b c d e f", None, "a  b"]
    r.shuffle(texts)
    out = {x.doc_id: x.class_id for x in N.classed(docs(texts)).collect()}
    assert [out[i] for i in range(len(texts))] == brute([t or "" for t in texts])


def test_no_link_is_lost_in_one_large_group(spark, docs, monkeypatch):
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts = family(r, words, 150, 14)
    found = brute(texts)
    assert 3 < len(set(found)) < 140
    monkeypatch.setattr(N, "BLOCK_BYTES", 1 << 14)
    out = {x.doc_id: x.class_id for x in N.classed(docs(texts)).collect()}
    assert [out[i] for i in range(len(texts))] == found


def test_edges(spark):
    t = " ".join(f"w{i}" for i in range(40))
    rows = [(5, t, "x"), (5, t, "x"), (None, t, "y"), (3, t + " more", "z"), (None, "other", "q")]
    out = N.classed(spark.createDataFrame(rows, "doc_id long, text string, class_id string")).collect()
    assert sorted((r.doc_id or 0, r.class_id or 0, r.is_kept) for r in out) == [(0, 0, True), (0, 3, False), (3, 3, True), (5, 3, False), (5, 3, False)]
    assert N.classed(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_without_keys_are_linked(spark):
    a, b = "one two three four five six seven eight nine ten eleven twelve " * 3, "other words stand in this text which is like no other text here"
    near = "zero " + a * 2
    rows = [(None, a * 2), (None, near), (None, a * 2), (7, b), (None, b + " too and on"), (None, None), (None, "")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, Class_ID string, first_row_of_class int")
    found = N.classed(df)
    assert found.columns == ["doc_id", "text", "first_row_of_class", "class_id", "is_kept"]
    out = found.collect()
    assert sum(r.is_kept for r in out if r.text in (a * 2, near)) == 1 and all(r.class_id is None for r in out if r.text in (a * 2, near))
    assert [r.class_id for r in out if r.text == b] == [7] and sum(r.is_kept for r in out if not r.text) == 1


def test_a_near_copy_without_a_key_joins_the_class_of_one_with_a_key(spark):
    a = " ".join(f"word{i}" for i in range(200))
    out = N.classed(spark.createDataFrame([(None, a + " more"), (5, a), (9, a + " other")], "doc_id long, text string")).collect()
    assert {r.class_id for r in out} == {5} and [r.doc_id for r in out if r.is_kept] == [5]


def test_very_long_texts(spark):
    a = " ".join(f"word{i % 50021}" for i in range(150_000))
    out = N.classed(spark.createDataFrame([(1, a), (2, a + " end"), (3, a[: len(a) // 2])], "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in out} == {1: 1, 2: 1, 3: 3}
    assert N.classed(spark.createDataFrame([], "doc_id long, text string")).count() == 0
