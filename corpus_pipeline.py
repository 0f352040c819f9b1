"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's docs. All but the last return the columns of documents.
Columns of other names are not read and go. Texts are read whole, however long; ids may be
null or repeat; without rows a stage returns none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import exact_dedup, packing, quality, secret_scan, shingle_dedup
from quire.llm.common import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts get the score of a text without tokens; equal texts go or stay
    together; without usable labels all scores are the share of ones, or 0.5, and all stay.
    """
    return quality.accepted(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays: the longest, then that of the smallest doc_id.

    Null texts equal empty ones. Of repeated rows one stays; a null id comes last.
    """
    return exact_dedup.kept_rows(docs, COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest doc_id.

    Null and empty texts are copies of each other; a null id comes last; of rows that share
    the smallest id the first by place stays.
    """
    return shingle_dedup.kept_rows(docs, COLUMNS, words=5, least=0.8)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; every row stays, null and empty texts as they are."""
    return secret_scan.without_secrets(docs.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 1024 tokens.

    A null or empty text is its closing id alone; repeated rows are packed one by one.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", keep_quality),
    ("exact_dedup", drop_copies),
    ("shingle_near_dedup", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

#: No SQL expresses the classifier, the near copies or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the result is that of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
