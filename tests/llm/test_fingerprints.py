"""Fingerprints of short texts."""

import pytest

from millrace.llm import fingerprints
from pyspark.sql import functions as F


@pytest.mark.parametrize("n", [1, 4, 5, 8, 14, 30])
def test_short_texts_are_contained_in_long_ones(spark, n):
    words = [[f"w{i}x{j}" for j in range(400)] for i in range(40)]
    rows = [(" ".join(w[:n]), " ".join(w if n > 4 else w[:n]), " ".join(words[i - 1][:n])) for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    for x in "abc":
        df = fingerprints.fingerprinted(df, f"{x}_fp", x)
    df = fingerprints.fingerprinted(df.withColumn("u", F.concat_ws(" ", "a", "c")), "u_fp", "u")
    out = df.select(fingerprints.likeness(F.col("a_fp"), F.col("b_fp")).alias("same"), fingerprints.likeness(F.col("a_fp"), F.col("c_fp")).alias("other"), fingerprints.containment(fingerprints.merged(F.array("a_fp", "c_fp")), F.col("u_fp")).alias("union")).collect()
    assert all(r.same == 1 and r.other == 0 and (n < 5 or r.union == 1) for r in out)


@pytest.mark.parametrize("key", [None, 5, 2**62])
def test_next_of_many_rows_of_one_key(spark, key):
    df = spark.createDataFrame([(key, f"t{i % 10}") for i in range(300)] + [((key or 1) - 8, "first"), (None, "last")], "doc_id long, text string").repartition(3).cache()
    out = fingerprints.with_next(df, ["text"], "doc_id", "then", parts=6)
    parts = out.select(F.spark_partition_id().alias("p")).distinct().count()
    rows = out.collect()
    assert len(rows) == 302 and sorted(r.text for r in rows) == sorted(r.then.text for r in rows) and parts > 1
    assert [r.text for r in rows if r.then.text == "first"] in ([["last"]] if key else [["last"], *([f"t{i}"] for i in range(10))])


def test_values_by_sets(spark, tmp_path):
    """near_edited and near_next of the query against sets of shingles."""
    from millrace.llm import queries

    texts = ["a b c d e f g h " * 4, "a b c d e f g h i j k " * 3, "", None, "one two", "a b c d e f g h x y z " * 2]
    spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id // 3: r for r in queries.op5_fingerprints(spark, str(tmp_path)).collect()}
    own = [t or "" for t in texts]

    def like(a, b):
        x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.split()) else set() for t in (a, b))
        share = lambda p, q: len(p & q) / len(p) if p else float(not q)
        return max(share(x, y), share(y, x))

    for i, t in enumerate(own):
        n = own[(i + 1) % len(own)]
        assert out[i].near_next == like(t, n) and out[i].near_edited == like(t, t[: len(t) - len(t) // 2] + n[: len(t) // 2])
        assert len(set(out[i].fingerprint.split(","))) == len({tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))})
