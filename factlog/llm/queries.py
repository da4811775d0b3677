"""One query for each operator, over its whole table and with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from factlog.llm import bpe, embedding_dedup, host_rules, language_id, ngram_join, oracles, packing, pii, pii_examples, pitman_yor, quality, spelling, spotsigs, token_counts, whitening
from factlog.llm.common import fold, table


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(table(spark, sf_dir, "embeddings"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"), pii.train(pii_examples.examples()))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(1, 3))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.best_fit(docs, rows=packing.near_copies(docs))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents")).drop("n_words")


def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.spot_fingerprints(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"), fold(2, 4))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op10_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.lm_scores(table(spark, sf_dir, "documents"), fold(2, 7))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.host_rules(table(spark, sf_dir, "documents")).drop("host_rules")


QUERIES = {"op1_embedding_dedup": op1_embedding_dedup, "op2_token_counts": op2_token_counts, "op3_pii": op3_pii, "op4_packing": op4_packing, "op5_quality": op5_quality, "op6_ngram_join": op6_ngram_join, "op7_spotsigs": op7_spotsigs, "op8_language_id": op8_language_id, "op9_bpe": op9_bpe, "op10_pitman_yor": op10_pitman_yor, "op11_whitening": op11_whitening, "op12_spelling": op12_spelling, "op13_host_rules": op13_host_rules}
ORACLE_SQL: dict[str, str] = dict(oracles.ORACLE_SQL)
