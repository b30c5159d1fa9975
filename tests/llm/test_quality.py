"""Lines that copies carry."""

import random

from millrace.llm import queries


def test_lines_of_copies_count_by_document(spark, tmp_path):
    r = random.Random(1)
    text = lambda: "\n".join(" ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(12)) for _ in range(6))
    hot, repeated = text(), "\n".join([text(), *[" ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(12))] * 25])
    rows = [(i, hot, "a") for i in range(60)] + [(60 + i, text(), "a") for i in range(20)] + [(80, hot, "b"), (81, repeated, "a"), (82, None, "a")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    out = {x.doc_id: x for x in queries.op9_quality(spark, str(tmp_path)).collect()}
    assert len(out) == 83 and all(out[i].kept_share == 0 and not out[i].kept for i in range(60))
    assert all(out[i].kept_share == 1 for i in range(60, 82))
