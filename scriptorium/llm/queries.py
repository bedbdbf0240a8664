"""The registered queries of the ten operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import bpe, chat, fingerprints, html_extract, mixing, pii, quality_rules, simhash_dedup, token_counts, url_filter
from scriptorium.tables import table


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash_dedup.near_duplicate_classes(table(spark, sf_dir, "documents"), words=3, radius=3)
    return classes.select("doc_id", simhash_dedup.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokens = bpe.encoded(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, round_trip=True)
    return tokens.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("pii_spans")
    return found.select(
        "doc_id",
        *(pii.count_of(spans, name).alias(f"n_{name}") for name in ("email", "ip", "card", "phone")),
        F.sha2(pii.spans_text(pii.base_spans(spans)), 256).alias("base_sha256"),
        pii.spans_text(spans).alias("spans"),
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judged(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = fingerprints.digests_with_neighbours(table(spark, sf_dir, "documents"), radius=3, every=20)
    hexadecimal = [F.lower(F.hex(c)).alias(c) for c in ("fingerprint", "edited_fingerprint")]
    return compared.select("doc_id", "n_chars", "edited_sha256", *hexadecimal, "near_edited", "near_next", "n_near", "least_near")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return found.select("doc_id", *(F.col(f"quality.{f}").alias(f) for f in fields))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rendered(table(spark, sf_dir, "conversations"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), temperature=0.5, size=1.0, seed=1)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_simhash_dedup,
        op2_byte_bpe,
        op3_pii,
        op4_url_filter,
        op5_token_counts,
        op6_document_fingerprints,
        op7_quality_rules,
        op8_chat_formatting,
        op9_mixing,
        op10_html_extraction,
    )
    return {f.__name__: f for f in found}
