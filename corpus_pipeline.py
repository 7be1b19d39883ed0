"""From raw documents to packed training sequences, in five stages.

Each stage reads what its predecessor wrote. The first four return the columns of documents; the
last says which sequence holds which piece of which document. Labels and the texts that they speak
of come from the tables, as earlier stages remove most documents with a bad label.

All stages take texts of any length and tables without rows, keep columns of any name, and settle ties
by id; what they do with nulls and repeated rows stands with each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import mixing, near, packing, pii, rules, tokens
from larkspur.llm._shared import materialise


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no certified rule. A null text counts as empty; a null language is a
    stratum of its own; a stratum without labels keeps all."""
    return rules.passing(docs, _table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the least doc_id; texts without words are in no
    group, rows with a null id all stay, of rows with the same id and text one stays; rows that share
    an id but not their text are documents of their own."""
    return near.without_near_copies(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked and n_chars brought up to date; a null text stays null."""
    return pii.mask_pii(docs)


def target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the rates for the target weights of domains ask for: those that look low
    or toxic go, clean ones may come twice; null or empty texts have a rate near 1, rows with a null id
    stay once."""
    return mixing.resample(docs, _table(spark, sf_dir, "labels"), label_docs=_table(spark, sf_dir, "documents"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, part, seq_id, seq_offset, n_tokens; documents without tokens are in no sequence,
    repeated rows are packed each."""
    return packing.pack(tokens.with_token_counts(docs, "doc_id", "text"))


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_copies),
    ("pii", personal_data),
    ("mixing", target_weights),
    ("best_fit_packing", packed),
]

#: Rates come from an iterative solver and a fitted classifier, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
