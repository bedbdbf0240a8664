"""Corpus preparation: quality rules, near-duplicates, personal data, source mix, tokens.

Each stage works on all that its predecessor kept, is written as Parquet and read again, so a later stage neither
recomputes an earlier one nor depends on the executors that ran it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm import bpe, mixing, near_copies, pii, quality_rules
from scriptorium.llm.lineage import discard, discard_since, mark, shared_folder
from scriptorium.tables import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: rejected documents go, failed lines are removed from the others."""
    return quality_rules.cleaned(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: one document of each group of near copies (five words, a likeness of 0.8) stays."""
    return near_copies.keep_one_of_each_group(docs, words=5, similarity=0.8)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: spans are replaced by their kinds."""
    return pii.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: documents are repeated or left out, then shuffled globally."""
    return mixing.mixed(docs).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: the ids of each text, packed as little-endian unsigned 32-bit integers."""
    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=("doc_id", "lang", "source"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", clean),
    ("simhash_near_dedup", deduplicate),
    ("pii", redact),
    ("source_mixing", mix),
    ("byte_bpe", tokenize),
]

#: Hashing by XXH64 and the merges of a tokenizer are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to a folder of its own in the shared place and read again.

    A stage's folder is deleted once the next one is written, and what a stage keeps for itself once it is written, so
    two stages' tables exist at most; the last stays, as the result reads it. Columns beyond those of ``documents`` are
    left out, null and empty texts are rejected by the first stage, different documents that share a doc_id are kept
    apart, and an empty table gives an empty result.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    before = None
    for number, (name, stage) in enumerate(STAGES):
        path, place = f"{folder}/{number}-{name}", mark()
        stage(spark, docs, sf_dir).write.parquet(path)
        discard_since(spark, place)
        docs = spark.read.parquet(path)
        if before is not None:
            discard(spark, before)
        before = path
    return docs
