"""A training-data pipeline over `documents`: each stage works on all that the one before it kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; run() writes each result as Parquet and
hands the reread table on. Stages decide on rows and not on doc_ids, so of repeated rows each is judged,
and the two dedup stages keep one row of a group, whatever doc_ids it has. Null texts count as empty; the
quality rules drop these and all texts of under 20 words. Rows without a doc_id pass like others and come
last where one of a group is chosen. Columns that documents may have besides pass all stages but the last,
whatever their names. Texts are read whole, however long. An empty table gives no pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import exact_dedup, near_dedup, packing, quality_classifier, quality_rules
from corpusloom.llm.queries import fold, table
from corpusloom.session import ship, write_table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from the labels outside its held-out third, does not reject."""
    ship(spark)
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"), fold() % 3 != 1)
    return docs.where(quality_classifier.let(quality_classifier.statistics(), model.column) >= 0.5)


def keep_ruled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the repetition limits keep."""
    ship(spark)
    return quality_rules.keep_documents(docs)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    ship(spark)
    return exact_dedup.keep_documents(docs)


def keep_unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, at five words and a similarity of 0.8."""
    ship(spark)
    return near_dedup.keep_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_good),
    ("quality rules", keep_ruled),
    ("exact dedup", keep_distinct),
    ("minhash near-dedup", keep_unlike),
    ("packing", packed),
]

#: A learnt classifier, suffix arrays and a tokenizer have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
