"""The pipeline's stages by their definitions, on texts of which it is known what should stay."""

import os
import random
import re
import sys

import pytest
from test_suffix_dedup import brute

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages():
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES)


def test_stages_on_known_texts(spark, stages, tmp_path):
    r = random.Random(3)
    speak = {"aa": ["bado", "kuno", "tira", "lamo", "seli", "vimo", "gado"], "bb": ["xyqu", "zwick", "pflu", "örk", "schna", "grütz", "knuff"]}
    say = lambda k, n: " ".join("".join(r.choices(speak[k], k=2)) for _ in range(n))
    texts = [say(k, r.randint(30, 120)) for k in ["aa", "bb"] * 60]
    passage = say("aa", 15)
    texts[3] = texts[1] + " ende"  # a near copy
    texts[5] = texts[2]
    texts[20], texts[24] = f"{texts[20]} {passage} {texts[22]}", f"{passage} {texts[24]}"
    for i in range(40, 60):
        texts[i] += " token = " + "".join(r.choices("0123456789abcdef", k=40))
    rows = [(i, t, ["aa", "bb"][i % 2], "s", len(t)) for i, t in enumerate(texts)]
    rows += [(1000, None, None, None, None), (1001, "", "aa", "s", 0), (1002, "12 34 ::", "bb", None, 8), (1003, "ψωμί " * 40, None, "s", 200), (7, texts[7], "bb", "s", 5)]
    docs, seen = spark.createDataFrame(rows, DOCS).repartition(3), []
    for i, stage in enumerate(stages.values()):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        seen.append(docs.collect())
    language, near, passages, secrets, packed = seen
    assert not {x.doc_id for x in language} & {1000, 1001, 1002, 1003} and len(language) >= 118
    assert {x.doc_id for x in language} - {x.doc_id for x in near} <= {3, 5} and sum(x.doc_id == 7 for x in near) == 1
    assert not {3, 5} & {x.doc_id for x in near}
    own = sorted(near, key=lambda x: x.doc_id)
    want = brute([x.text.encode() for x in own])
    assert {x.doc_id: x.text for x in passages} == {x.doc_id: w[0].decode("utf-8", "ignore") for x, w in zip(own, want)}
    assert any(w[2] for w in want) and all(x.n_chars == len(x.text) for x in passages)
    mark = {x.doc_id: re.sub("token = [0-9a-f]{40}", "[secret]", x.text) for x in passages}
    assert {x.doc_id: x.text for x in secrets} == mark and sum(t.endswith("[secret]") for t in mark.values()) > 10
    from tokenizers import Tokenizer

    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert {x.doc_id: len(tok.encode(x.text, add_special_tokens=False).ids) + 1 for x in secrets} == {x.doc_id: x.length for x in packed}


def test_empty_and_null_documents(spark, stages, tmp_path):
    for k, rows in enumerate(([], [(None, None, None, None, None), (None, "", None, None, None), (1, None, "aa", None, 0)])):
        for i, (name, stage) in enumerate(stages.items()):  # each stage by itself
            out = stage(spark, spark.createDataFrame(rows, DOCS), str(tmp_path))
            out.write.parquet(f"{tmp_path}/{k}-{i}")
            n = spark.read.parquet(f"{tmp_path}/{k}-{i}").count()
            assert n == (0 if not rows or name == "language ID" else 1 if name == "near duplicates" else 3)


def test_run_leaves_no_folders_but_the_last(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(1)
    rows = [(i, " ".join("".join(r.choices("abcdeginorst", k=4)) for _ in range(40)), "en", "s", 1) for i in range(30)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert 25 <= out.select("doc_id").distinct().count() <= 30
    (folder,) = {os.path.dirname(os.path.dirname(f)) for f in out.inputFiles()} or {None}
    assert folder is None or len([d for d in os.listdir(folder.removeprefix("file://"))]) <= 1
