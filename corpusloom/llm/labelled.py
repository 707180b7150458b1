"""The labelled rows that a classifier learns from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chosen_labels(labels: DataFrame, label: str, learn: Column, max_rows: int) -> DataFrame:
    """doc_id, y: those of smallest hash of doc_id, at most max_rows labels for which the condition `learn` on doc_id holds.

    Null labels and null doc_ids are left out; of repeated labels the highest holds.
    """
    held = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & learn)
    once = held.groupBy("doc_id").agg(F.max("y").alias("y"))
    return once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def with_texts(chosen: DataFrame, docs: DataFrame) -> DataFrame:
    """chosen with text: one row for each doc_id that docs has; of its texts the longest, then the greatest."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    rest = [c for c in chosen.columns if c != "doc_id"]
    best = F.max(F.struct(F.char_length("text").alias("n"), F.col("text").alias("text"))).alias("best")
    return rows.groupBy("doc_id", *rest).agg(best).select("doc_id", *rest, "best.text")
