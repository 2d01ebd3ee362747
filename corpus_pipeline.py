"""A training-data pipeline of the corpus operators over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``. Stages work on every row
that their predecessor kept; all but the last return the columns of documents,
and any further columns of their input, whatever these are called.

Defined cases hold for all stages: an empty table gives an empty table; repeated
rows are rows, which each stage treats alike; texts are looked at whole, however
long they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from coopspark.llm import bpe, minhash, mixing, quality, toxicity
from coopspark.plans.stage import written


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator doesn't reject.

    A null, empty or wordless text has no features and gets the score of the
    model's bias; a null doc_id is scored like any other and never teaches; of
    labelled ids that repeat, the least text teaches. A score of exactly 0.5 is
    rejected. Without labels of toxic documents nothing is rejected.
    """
    return toxicity.keep_clean(docs, toxicity.fit(docs, _labels(spark, sf_dir)))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality operator doesn't reject.

    A null or empty text is scored by the features of an empty text; a null
    doc_id is scored like any other and never teaches. A score of exactly 0.3
    stays. Where labels don't hold both kinds, every score is 1 and all stay.
    """
    return quality.keep_good(docs, quality.fit(docs, _labels(spark, sf_dir)))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one of least doc_id.

    Null, empty and wordless texts are linked with nothing and all stay; of
    repeated rows one stays, any of them; a group whose ids are all null keeps
    one row.
    """
    return minhash.deduplicate(docs, width=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    A null source is a source, the last one; a null or empty text has no words
    and is taken only with the whole copies of its source; rows alike in doc_id
    and text are interchangeable, and as many are taken as the target asks for.
    """
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and round-trip digests of each document taken.

    A null or empty text has no ids and no bytes; a null doc_id is carried
    along; documents taken twice come twice.
    """
    ranks = bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.digests(bpe.encode(docs, ranks, public_tokenizers.PATTERN))


STAGES = [("toxicity", clean), ("quality", good), ("near_duplicates", distinct), ("mixing", mixed), ("byte_bpe", encoded)]

#: Learned scores and tokenizers have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
