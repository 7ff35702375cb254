"""The corpus pipeline: quality classifier, near-dedup by SimHash and by shingle similarity, suffix-array dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept. The first three return the columns of their
input: documents that the classifier rejects go, one document of each group of near duplicates stays, and repeated
strings of 200 bytes are cut out of the texts. The last returns the packed pieces. Nulls, empty tables, repeated rows
and further columns have the results that the operators' own docstrings define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from carvelake.llm import similar
from carvelake.llm.common import saved, table
from carvelake.llm.packing import pack_documents
from carvelake.llm.quality import keep_good
from carvelake.llm.simhash import keep_one
from carvelake.llm.suffix_dedup import cut_repeats
from carvelake.session import ship


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return keep_good(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """op8's own groups, by 3-word fingerprints within 3 bits, through its byte-position index and count filter."""
    ship(spark)
    return keep_one(docs)


def similar_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near duplicates that fingerprints of 64 bits can't reach: five-word shingles, similarity 0.8 or more, each link verified."""
    ship(spark)
    return similar.keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's near-dedup: SimHash first, then similarity among the rows that it keeps."""
    return similar_near_dedup(spark, saved(simhash_near_dedup(spark, docs, sf_dir), "pipeline-simhash"), sf_dir)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return cut_repeats(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express none of the four; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
