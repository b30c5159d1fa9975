"""The text operators applied to whole tables: opN_<name> for operator N, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, fingerprints, language_id, near_dedup, oracles, packing, quality, secrets, sharding, suffix_dedup, url_filters
from .common import table

SHARDS = 16
#: The url rules of the query: (action, host and start of the path).
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


#: The tables' hosts are registered below these, as below a public suffix of two labels.
SUFFIXES = ["example.com", "example.net", "example.org"]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.sharded(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return out.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages with `good`: 1 or 0 where the document that the url numbers is labelled (good: of quality and not toxic)."""
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("labelled")).agg(F.max(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")).alias("good"))
    number = F.regexp_extract(F.coalesce("url", F.lit("")), r"/([0-9]{1,18})(?:\.html)?/?(?:[?#]|$)", 1)
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.when(number != "", number.cast("long")).alias("labelled"))
    return pages.join(labels, "labelled", "left").select("page_id", "url", "good")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filters.judged(page_outcomes(spark, sf_dir), F.col("good"), RULES, suffixes=SUFFIXES)
    return out.select("page_id", "host", "path", "rule", "verdict")


def language_model(docs: DataFrame) -> language_id.Model:
    return language_id.fit(docs.filter(language_id.fold(F.col("doc_id")) != 1))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language_id.identified(docs.select("doc_id", "text"), language_model(docs))
    return out.select("doc_id", F.coalesce(language_id.fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = lambda df: fingerprints.fingerprinted(df, "fp")  # noqa: E731  made where rows have come to: fingerprints are larger than texts
    both = fingerprints.with_next(docs, ["text"], "doc_id", "then", after=own, more=["fp"])
    both = both.withColumns({"edited": fingerprints.edited(F.col("text"), F.col("then.text")), "next_fp": F.col("then.fp")})
    both = fingerprints.fingerprinted(both, "edited_fp", "edited")
    return both.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprints.written(F.col("fp")).alias("fingerprint"), fingerprints.written(F.col("edited_fp")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), fingerprints.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = secrets.found(docs, secrets.fitted(secrets.labelled_tokens(docs)))

    def count(kind: str):
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind, *_ in secrets.FORMS]
    return out.select("doc_id", *counts, F.sha2(secrets.written(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), secrets.written(F.col("all_spans")).alias("spans"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.tokenized(docs, vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=False).drop("text")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.in_sequences(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("word_bpe_49k.json"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judged(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", *quality.STATS, "base_failed", "kept", "kept_share")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classed(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id")


def queries() -> dict:
    import corpus_pipeline

    own = [op1_shards, op2_url_filters, op3_language, op4_suffix_dedup, op5_fingerprints, op6_secrets, op7_byte_bpe, op8_packing, op9_quality, op10_near_dedup]
    own = {f.__name__: f for f in own}
    return own | {"pipeline": corpus_pipeline.run} | oracles.queries(own)


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
