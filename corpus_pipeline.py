"""A training-corpus pipeline: each stage gets what its predecessor kept, written and read again.

1. language ID: documents without a recognised language go
2. near-duplicate removal: of each group the document with the least doc_id stays
3. repeated strings: every byte inside a 200-byte string that also starts elsewhere goes
4. benchmark decontamination: contaminated documents go
5. byte-level BPE: the token ids of the text, and what they decode to
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tailgauge.llm import bagminhash, bpe_tree, ppm_language, run_length_dedup, suffix_automaton
from tailgauge.llm.queries import table, vocabulary
from tailgauge.session import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ppm_language.keep_known(docs)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bagminhash.keep_one(docs)


def remove_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return run_length_dedup.without_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_automaton.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_tree.encoded(docs, *vocabulary())


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", remove_near_duplicates),
    ("suffix_dedup", remove_repeated_strings),
    ("decontaminate", decontaminate),
    ("tokenize", tokenize),
]

#: SQL expresses neither the context trees nor the encoding; the tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of every document that is left."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
