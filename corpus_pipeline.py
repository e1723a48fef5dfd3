"""The corpus pipeline: five stages, each on all that the one before kept.

Defined cases, of all stages: a null or empty text is scored like any other, fails the rules
and never reaches the later stages; texts of any length are taken whole; ids that repeat are
one document from the third stage on, where one row of them stays; an empty table gives an
empty one; extra columns, whatever their names, stay up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from verdigris.llm import neardup, packing, pii, quality_model, quality_rules
from verdigris.llm.common import pii_key, table, written
from verdigris.session import made, removed


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on this input's labels, accepts."""
    return quality_model.accepted(docs, table(spark, sf_dir, "labels"))


def quality_rule_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality_rules.passing(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return neardup.deduplicated(docs)


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data."""
    return pii.pseudonymised(docs, key=pii_key(spark))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces, placed in sequences."""
    packed = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rule_filter),
    ("minhash_near_dedup", minhash_near_dedup),
    ("pii", pii_surrogates),
    ("best_fit_packing", best_fit_packing),
]

#: A trained classifier and a tokenizer are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's result is written and read again.

    What the stages before wrote is removed as soon as the next result is there.
    """
    docs, since = table(spark, sf_dir, "documents"), len(made(spark))
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        removed(spark, since, keep=(made(spark)[-1],))
    return STAGES[-1][1](spark, docs, sf_dir)
