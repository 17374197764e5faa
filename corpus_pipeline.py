"""A training corpus from `documents`: quality rules, near-duplicate removal, substring removal, redaction, packing.

Each stage works on all rows that the one before it kept; the last returns one row for each packed piece.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import _shared, near_dups, packing, pii, quality, substring

#: DuckDB has no counterpart of the divergence, near-duplicate, boosted and packing stages; tests/llm checks the run against a brute-force version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the base rules and lie near their language's references; rows unchanged.

    Null and empty texts have no words and go; equal rows are judged alike; very long texts are judged whole; an empty table stays empty; other columns play no part.
    """
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates; rows unchanged.

    Null and empty texts are one class; of a class, the first text read stays, and of its copies the row of the least doc_id (null last, ties by any); an
    empty table stays empty; other columns play no part.
    """
    return near_dups.drop_near_duplicates(docs)


def _counted(docs: DataFrame) -> DataFrame:
    """docs with n_chars brought up to date, where it has this column."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of windows that occur more than once; a text that loses words holds the others joined by one space, and n_chars follows.

    Null texts stay null; texts of fewer than 35 words, and such as share no window, are unchanged to the byte; a text may become empty; an empty table
    stays empty; other columns are kept as they are.
    """
    return _counted(substring.strip_repeats(docs))


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data replaced by its kind in brackets; n_chars follows.

    Null texts stay null; texts without spans are unchanged; spans that touch are one; an empty table stays empty; other columns are kept as they are.
    """
    return _counted(pii.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence of at most 1024 ids.

    Null and empty texts have their end id only; repeated rows and null doc_ids are documents of their own; very long texts are cut into as many sequences as
    they need; an empty table gives no rows; other columns are not returned.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("redaction", redaction), ("packed", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = _shared.Cut(stage(spark, docs, sf_dir), f"stage-{name}").df
    return STAGES[-1][1](spark, docs, sf_dir)
