"""The corpus pipeline: stages over documents, each written as Parquet and read again before the next.

Every stage works on all that its predecessor kept. Stages 1 to 4 return the columns of documents, and
columns besides those of the contract go through them unread, whatever their names. A stage's table is
deleted once the next one is written, so two of them are on disk at a time. Ids are whole numbers, or null.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docweave.llm import bbpe, decontam, pii, quality, simhash
from docweave.plans.session import discard, scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the line labels reject go.

    Null and empty texts go: they have fewer words than the rules ask for. Repeated rows, ties of ids and
    null ids are judged row by row. Without labels of both kinds the shipped field decides. An empty
    table stays empty.
    """
    return quality.retain(docs, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the least id's, if any has an id.

    Rows are told apart by id and text: equal rows are one document, texts that share an id or have none
    are as many as they are. Texts without words are copies of each other. An empty table stays empty.
    """
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any window of a benchmark item go, whether the item has an id or not.

    Null and empty texts hold none and stay. An empty benchmark, or an empty table, takes nothing away.
    """
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in angle brackets, and n_chars follows.

    A null text stays null. Every row stays, repeated ones too. An empty table stays empty.
    """
    return pii.replace(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of the bytes they decode to: doc_id, n_tokens, two digests, ids.

    A null text has no tokens. Repeated rows and null ids each have their row. No rows come of an empty table.
    """
    return bbpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True).drop("decoded")


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("personal data", mask_personal_data),
    ("byte-level bpe", tokenize),
]

#: No SQL expresses the field's training, the trees or the tokenizer; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = scratch(spark, f"stage{i + 1}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                discard(spark, before)
            before = path
    return docs
