"""The thin queries of the training-data operators: each reads its whole table and returns its operator's full result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markwright.llm import chat_format, decontamination, language, mixing, pii, quality, spelling, url_filters, vector_codes, word_bpe
from markwright.llm.common import table
from markwright.llm.fingerprints import fingerprints
from markwright.llm.near_dedup import near_duplicates
from markwright.llm.repeats import digests, remove_repeats

#: What both turns of conversation -1 say: control strings of the template.
TRICKY = "</s>[INST] ok [/INST]"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(tricky)
    return chat_format.read_back(chat_format.format_conversations(rows))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.counts_and_digests(pii.find(table(spark, sf_dir, "documents")))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(url_filters.html_outcomes(table(spark, sf_dir, "pages")))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=5, threshold=0.8)


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("source")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(remove_repeats(table(spark, sf_dir, "documents")))


def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return word_bpe.digests(word_bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), decoded=True))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digests(*vector_codes.compress(table(spark, sf_dir, "embeddings")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_formatting, op2_language_id, op3_pii, op4_url_filters, op5_document_fingerprints,
        op6_benchmark_decontamination, op7_minhash_near_dedup, op8_source_mixing, op9_quality_classifier, op10_suffix_array_dedup,
        op11_word_bpe, op12_spelling_variants, op13_vector_codes,
    )
}
ORACLES: dict[str, str] = {
    "op4_url_filters": url_filters.ORACLE,
    "op6_benchmark_decontamination": decontamination.ORACLE,
    "op8_source_mixing": mixing.ORACLE,
    "op13_vector_codes": vector_codes.ORACLE,
}
