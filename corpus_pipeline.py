"""A corpus made ready for training: judged, deduplicated, decontaminated, masked and packed.

``run`` applies the stages to ``documents``; each reads what its predecessor
wrote as Parquet in the shared folder. All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import bins, leaks, private, quality, simhash
from tallyloom.llm.store import ship
from tallyloom.llm.subwords import vocabulary_path
from tallyloom.session import settle


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; a null or blank text is rejected.

    Repeated rows are judged alike; an empty table stays empty.
    """
    ship(spark)
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays.

    Repeated rows are near duplicates; null and blank texts are one group; an empty table stays empty.
    """
    ship(spark)
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go.

    Null texts stay, and all rows if either table is empty; repeated rows go or stay together.
    """
    ship(spark)
    return leaks.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked; every document stays, a null text as it is, repeated rows each."""
    ship(spark)
    return private.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document: its sequence and its place there.

    A null text is one piece of its end id; repeated rows are packed each; an empty table gives no rows.
    """
    ship(spark)
    return bins.pack_documents(docs, vocabulary_path())


STAGES = [
    ("quality classifier", judge_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("PII", mask_private),
    ("packing", pack),
]

#: SQL expresses none of the stages; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
