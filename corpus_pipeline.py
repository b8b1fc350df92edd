"""The corpus pipeline: quality rules, exact and near deduplication, redaction, packing.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` over all that its predecessor
kept, and its decisions take effect. ``run`` writes each stage's result to the
cluster's shared folder and reads it back as the next one's documents. All but
the last stage return the columns of ``documents``.

Nulls, empty and very long texts, ties, repeated rows, empty tables and extra
columns are handled as each operator's docstring says: a document without text is
rejected by the quality rules, equal texts keep one row, rows without an id are
never near-duplicates to drop, and extra columns go through unchanged up to the
last stage, which returns pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import exact_dedup, packing, pii, quality, simhash
from attestra.llm.common import documents, staged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.keep(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    index = exact_dedup.DigestIndex(spark, exact_dedup.new_table_name())
    out = exact_dedup.dedupe(docs, index, "first")
    index.drop()
    return out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one_of_each(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; ``n_chars`` follows the text if it is there."""
    out = pii.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("redact_pii", redact_pii),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs


#: The tokenizer and the fingerprints aren't SQL; tests/llm checks run() against brute force.
ORACLE_SQL = None
