"""Counts and reports of a run, as aggregates over its events and signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The closed vocabulary of events; those that carry a count of their own.
EVENT_TYPES = (
    "document.fetched", "document.parsed", "document.invalidated", "document.version_skipped", "document.unreadable", "document.persisted", "document.failed", "chunk.truncated",
    "relation.upserted", "relation.pending", "relation.promoted", "relation.unknown", "saga.compensation.triggered", "saga.compensation.completed", "saga.compensation.failed",
)
COUNTED = ("document.fetched", "relation.upserted", "chunk.truncated", "document.version_skipped", "document.unreadable", "relation.unknown")
CATEGORIES = ("tags", "roots", "links")


def weight(event_type: Column, count: Column, counted=COUNTED) -> Column:
    """The count of an event that carries one, if it is a whole number and not negative; else 1."""
    n = count.try_cast("long")
    return F.when(event_type.isin(*counted) & (n >= 0), n).otherwise(F.lit(1))


def event_counts(events: DataFrame, counted=COUNTED) -> DataFrame:
    """event_type, n. events: event_type, count (string or null)."""
    return events.groupBy("event_type").agg(F.sum(weight(F.col("event_type"), F.col("count"), counted)).alias("n"))


def unknown_tally(signals: DataFrame) -> DataFrame:
    """category, value, n, example: documents with it, and the smallest (identifier, source_file). signals are distinct by document."""
    once = signals.groupBy("category", "value", "identifier").agg(F.min("source_file").alias("source_file"))
    return once.groupBy("category", "value").agg(F.count("*").alias("n"), F.min(F.struct("identifier", "source_file")).alias("example"))


def with_all_categories(tally: DataFrame) -> DataFrame:
    """category, values: the three categories, empty ones too."""
    all_three = tally.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
    grouped = tally.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("value", "n", "example"))).alias("values"))
    empty = F.array().cast("array<struct<value:string,n:bigint,example:struct<identifier:string,source_file:string>>>")
    return all_three.join(grouped, "category", "left").select("category", F.coalesce("values", empty).alias("values"))


def collision_tally(collisions: DataFrame) -> DataFrame:
    """source, key, n, example: the smallest list of files. collisions: source, identifier, key, files."""
    return collisions.groupBy("source", "key").agg(F.count("*").alias("n"), F.min("files").alias("example"))


def status(requested: Column, fetched: Column, persisted: Column, invalidated: Column, failed: Column) -> Column:
    """A requested ok holds if nothing failed and everything fetched is accounted for; with nothing fetched it holds too."""
    lost = (failed > 0) | (persisted + invalidated + failed != fetched)
    return F.when((requested == "ok") & (fetched > 0) & lost, F.lit("degraded")).otherwise(requested)


def merge_counts(*parts: DataFrame) -> DataFrame:
    """Sum of partial event counts; order and grouping of the parts do not matter."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("event_type").agg(F.sum("n").alias("n"))


def truncated_chunks(embedded: DataFrame) -> DataFrame:
    return embedded.where("truncated").agg(F.countDistinct("chunk_id").alias("n"))


def failure_tally(failures: DataFrame) -> DataFrame:
    """phase, type, n, example: documents that failed by a kind of error, and the smallest (identifier, message). failures: identifier, phase, type, message."""
    once = failures.groupBy("phase", "type", "identifier").agg(F.min("message").alias("message"))
    return once.groupBy("phase", "type").agg(F.count("*").alias("n"), F.min(F.struct("identifier", "message")).alias("example"))
