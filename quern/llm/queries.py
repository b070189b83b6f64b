"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quern.llm import bpe, brown_lm, conversation_repair, filter_audit, language_id, mixing, near_dedup, pii, quality_classifier, quality_rules, token_counts
from quern.llm.common import table
from quern.llm.exact_dedup import exact_groups
from quern.llm.sharding import interleaved_shards


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_quality(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleaved_shards(table(spark, sf_dir, "documents"), shards=40)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Token shares of the mixture; with the labels' domains, they thin low and toxic text.
MIXTURE = {"clean": 0.96, "low": 0.01, "toxic": 0.03}


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labelled = mixing.labelled_domains(docs, table(spark, sf_dir, "labels"))
    mixed = mixing.mix_documents(docs, labelled, MIXTURE)
    return mixed.select("doc_id", "n_tokens", *[mixed["posterior"][d].alias(f"p_{d}") for d in MIXTURE], "rate", "copies", *[mixed["target"][d].alias(f"target_{d}") for d in MIXTURE])


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_columns(pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digest_columns(bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    summary, turns = conversation_repair.repair_conversations(conversation_repair.damage(conversations), conversations)
    return conversation_repair.digest_columns(summary, turns)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = token_counts.read_vocabulary(spark, public_tokenizers.path("byte_bpe_50k.json"))
    return token_counts.count_columns(token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_near_dedup": op2_near_dedup,
        "op3_mixing": op3_mixing,
        "op4_language_id": op4_language_id,
        "op5_sharding": op5_sharding,
        "op6_lm_score": op6_lm_score,
        "op7_quality_classifier": op7_quality_classifier,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_personal_data": op9_personal_data,
        "op10_byte_bpe": op10_byte_bpe,
        "op11_filter_audit": op11_filter_audit,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_token_counts": op13_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_rules.oracle(),
        "op2_near_dedup": near_dedup.ORACLE,
        "op11_filter_audit": filter_audit.ORACLE,
        "op8_exact_dedup": """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents""",
    }
