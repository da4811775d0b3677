"""The document pipeline: filter by quality and language, keep one of each group of copies, redact, and pack `documents`.

What every stage does with odd rows is that of its operator: null and empty texts are texts without words, repeated rows and ids are rows like
any other unless a stage says otherwise, an empty table gives an empty one, and columns of any name pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factlog.llm import language_id, ngram_join, packing, pii, pii_examples, quality
from factlog.llm.common import fold, table, whole_texts
from factlog.session import discard, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that score at least 0.5. Null and empty texts are scored by their statistics; repeated rows stay or go together."""
    whole_texts(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), fold(1, 3))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose language is accepted. Null and empty texts and texts without a letter go."""
    whole_texts(spark)
    return language_id.keep_known(docs, fold(2, 4))


def copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id. Rows that repeat an id and its text become one; rows with a null id stay."""
    whole_texts(spark)
    return ngram_join.keep_one(docs)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with the personal data in their texts replaced by its kind, and n_chars counted anew. Null texts stay null."""
    whole_texts(spark)
    return pii.redact_documents(docs, pii.train(pii_examples.examples()))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every row in bins; a text without words is a piece of its own bin."""
    whole_texts(spark)
    return packing.best_fit(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("n-gram Jaccard join", copies_stage),
    ("PII", personal_data_stage),
    ("best-fit packing", packing_stage),
]
#: SQL cannot express the two trained filters; tests/llm/test_pipeline.py holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage returns is written as Parquet and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        last, docs = docs, written(stage(spark, docs, sf_dir))
        if k:
            discard(last)
    return STAGES[-1][1](spark, docs, sf_dir)
