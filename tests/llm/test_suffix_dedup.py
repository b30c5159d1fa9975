import random

import numpy as np
import pytest

from millrace.llm import suffix_dedup as S


def brute(texts, least=50):
    """By the definition; texts in key order."""
    first, out = {}, []
    for i, t in enumerate(texts):
        for p in range(len(t) - least + 1):
            first.setdefault(t[p : p + least], i)
    for i, t in enumerate(texts):
        gone = bytearray(len(t))
        for p in range(len(t) - least + 1):
            if first[t[p : p + least]] < i:
                gone[p : p + least] = b"\1" * least
        runs = len([r for r in bytes(gone).split(b"\0") if r])
        out.append((bytes(c for c, g in zip(t, gone) if not g), len(t), sum(gone), runs))
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    words = [bytes(r.choices(b"abcdeghinorst", k=r.randint(1, 7))) for _ in range(80)]
    say = lambda k: b" ".join(r.choices(words, k=k))
    passages = [say(r.randint(5, 40)) for _ in range(6)]
    texts = []
    for _ in range(n):
        kind = r.random()
        if texts and kind < 0.2:
            texts.append(r.choice(texts))
        elif texts and kind < 0.5:
            t = bytearray(r.choice(texts))
            for _ in range(r.randint(0, 4)):
                if t:
                    t[r.randrange(len(t))] = r.choice(b"xyz")
            texts.append(bytes(t))
        elif kind < 0.7:
            texts.append(say(r.randint(0, 30)) + b" " + r.choice(passages) + b" " + say(r.randint(0, 30)))
        elif kind < 0.8:
            texts.append(b"ab" * r.randint(0, 120) + b"c" * r.randint(0, 200))
        else:
            texts.append(say(r.randint(0, 60)))
    return texts


@pytest.mark.parametrize("data", [b"", b"a" * 300, b"banana" * 40, b"abracadabra" * 9, bytes(140), b"\0\0a\0\0b\0" * 30, bytes(range(256)) * 3])
@pytest.mark.parametrize("depth, batch, every", [(50, 1 << 17, 1), (50, 7, 1), (16, 30, 3), (9, 1, 1), (23, 64, 5)])
def test_refined(data, depth, batch, every):
    starts = np.arange(0, max(0, len(data) - depth + 1), every)
    order, group = S.refined(S.all_words(np.frombuffer(data + bytes(64), np.uint8)), starts, depth, batch)
    strings = [data[i : i + depth] for i in starts]
    names = sorted(set(strings))
    assert sorted(order) == list(range(len(starts)))
    assert [names[g] for g in group] == [strings[i] for i in order]


@pytest.mark.parametrize("seed", range(30))
def test_refined_at_random(seed):
    r = random.Random(seed)
    data = b"".join(corpus(seed, 20)) + bytes(r.choices(b"ab", k=200))
    starts = np.array(sorted(r.sample(range(len(data) - 50), r.randint(1, len(data) - 50))))
    order, group = S.refined(S.all_words(np.frombuffer(data + bytes(64), np.uint8)), starts, 50, r.choice([1, 10, 100, 1000]))
    strings = [data[i : i + 50] for i in starts]
    names = sorted(set(strings))
    assert [names[g] for g in group] == [strings[i] for i in order]


@pytest.mark.parametrize("seed", range(40))
def test_smallest_grams_over_steps(seed):
    r = random.Random(seed)
    data = np.frombuffer(bytes(r.choices(b"abcd"[: r.randint(1, 4)], k=r.choice([0, 34, 35, 36, 100, 32767, 32768, 70000]))) + bytes(64), np.uint8)
    n, reach = len(data) - 64, 35
    words = S.all_words(data)
    low, places, grams = S.smallest_grams(words, n, reach)
    all_ = S.mixed(words[:n] * S._M2 + words[8 : n + 8])
    want = S.slid(all_, reach, np.minimum) if n >= reach else all_[:0]
    assert (low == want).all()
    hit = {i + int(k) for i in range(len(want)) for k in np.flatnonzero(all_[i : i + reach] == want[i])} if n < 200 else None
    assert hit is None or places.tolist() == sorted(hit)
    assert (all_[places] == grams).all() and (np.diff(places) > 0).all()


@pytest.mark.parametrize("seed", range(4))
def test_as_defined(spark, seed):
    texts = [t.decode() for t in corpus(seed)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = S.deduplicated(df, block_bytes=1500, parts=3).orderBy("doc_id").collect()
    assert [(bytes(r.kept_bytes), r.n_bytes, r.n_removed, r.n_spans) for r in out] == brute([t.encode() for t in texts])


def test_one_key_for_all_rows_lies_in_many_blocks(spark):
    texts = [t.decode() for t in corpus(9)]
    for key in (7, None):
        out = S.deduplicated(spark.createDataFrame([(key, t) for t in texts], "doc_id long, text string"), block_bytes=1500, parts=3)
        assert out.agg({"n_removed": "sum"}).first()[0] == 0 and out.count() == len(texts)


def test_names_that_differ_in_case_only(spark, tmp_path):
    df = spark.createDataFrame([(1, "a" * 60, "x", "y")], "doc_id long, text string, N_BYTES string, dedup_BLOCK string")
    out = S.deduplicated(df)
    assert out.columns == ["doc_id", "dedup_BLOCK", "kept_bytes", "n_bytes", "n_removed", "n_spans"]
    out.write.parquet(f"{tmp_path}/out")


def test_a_very_long_text(spark):
    r = random.Random(3)
    long = " ".join("".join(r.choices("abcdefghij", k=6)) for _ in range(60000))
    rows = [(1, long[1000:1300]), (2, long), (3, "a" * 70000), (4, long[200_000:200_400])]
    out = {x.doc_id: x.n_removed for x in S.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=30000).collect()}
    assert out == {1: 0, 2: 300, 3: 0, 4: 400}


def test_edges(spark):
    passage = "one passage of many words that is repeated here and there, with ü in it"
    rows = [(3, passage, "x"), (1, None, "x"), (2, "", "x"), (None, passage, "x"), (4, passage[:20], "x"), (3, passage, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string")
    out = sorted((r.doc_id or 99, r.n_bytes, r.n_removed) for r in S.deduplicated(df).collect())
    n = len(passage.encode())
    assert out == [(1, 0, 0), (2, 0, 0), (3, n, 0), (3, n, 0), (4, 20, 0), (99, n, n)]
    assert S.deduplicated(df.limit(0)).count() == 0
