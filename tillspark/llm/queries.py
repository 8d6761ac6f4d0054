"""The registered queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillspark.llm import conversation_trie, disclosure, domain_mix, exact_dedup, filter_audit, language, lm_mixing, packing, page_text, pivots, quality, severity, weighted_minhash
from tillspark.llm.common import table


def op1_lm_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return lm_mixing.score_texts(table(spark, folder, "documents"))


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, folder, "documents"))


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_disclosure(spark: SparkSession, folder: str) -> DataFrame:
    return disclosure.digest_columns(disclosure.find(table(spark, folder, "documents")))


def op5_similar_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return pivots.similar_vectors(table(spark, folder, "embeddings"))


def op6_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return weighted_minhash.near_groups(table(spark, folder, "documents"))


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    marks = domain_mix.default_domains(table(spark, folder, "labels"))
    return domain_mix.mix(table(spark, folder, "documents"), marks)


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return severity.score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op12_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_trie.conversation_trie(table(spark, folder, "conversations"))


def op13_page_text(spark: SparkSession, folder: str) -> DataFrame:
    return page_text.extract(table(spark, folder, "pages"))


LLM_QUERIES = {
    f.__name__: f
    for f in (op1_lm_mixing, op2_exact_dedup, op3_quality, op4_disclosure, op5_similar_vectors, op6_near_dedup, op7_packing, op8_mixing, op9_toxicity, op10_language, op11_filter_audit, op12_conversation_trie, op13_page_text)
}
LLM_SQL = {
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op11_filter_audit": filter_audit.OP11_SQL,
    "op12_conversation_trie": conversation_trie.OP12_SQL,
}
