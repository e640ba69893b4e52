"""The training-data queries, each over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import bbpe, decontam, licenses, oracles, pii, quality, sharding, simhash, substring, suffix, tokencount

#: 5 regions of 2 racks of 4 shards.
SHARDS = sharding.Tree.even(5, 2, 4)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_vp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), SHARDS)


def op8_sparse_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.dedup(_table(spark, sf_dir, "documents"))
    shown = F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string")))
    return found.withColumn("spans", F.array_join(shown, ","))


def op9_viterbi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bbpe.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_rabin_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(_table(spark, sf_dir, "documents")).drop("spans")


def op4_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.rules(docs, docs, _table(spark, sf_dir, "labels"))


def op5_semi_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op6_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    lines = F.transform("matches", lambda m: F.concat_ws(":", m["line"].cast("string"), m["license"]))
    spans = F.transform("spans", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"), m["license"]))
    return found.select("doc_id", "n_lines", "n_license_lines", "n_license_spans", "licenses", F.round("best_dice", 6).alias("best_dice"), F.array_join(lines, ",").alias("matched"), F.array_join(spans, ",").alias("spans"))


def op7_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("items")


QUERIES = {
    "op1_simhash_vp": op1_simhash_vp,
    "op2_shard_tree": op2_shard_tree,
    "op3_rabin_karp": op3_rabin_karp,
    "op4_line_crf": op4_line_crf,
    "op5_semi_markov": op5_semi_markov,
    "op6_license_dice": op6_license_dice,
    "op7_wu_manber": op7_wu_manber,
    "op8_sparse_suffix": op8_sparse_suffix,
    "op9_viterbi_counts": op9_viterbi_counts,
    "op10_byte_bpe": op10_byte_bpe,
}
ORACLES: dict[str, str] = oracles.ORACLES
