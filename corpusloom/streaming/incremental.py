"""Runs as micro-batches: deferred edges are promoted when a batch brings their target; and rate limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators import graph
from corpusloom.operators.sinks import Store
from corpusloom.session import write_table

NODES = "identifier string, label string, props map<string,string>"
EDGES = "src string, dst string, type string, props map<string,string>, source string, doc string, seq int"
PENDING = "src string, dst string, type string, source string, props map<string,string>, first_seen_run string, last_seen_run string"
KEPT = "src string, dst string, type string, props map<string,string>, run_id string"


def _known(store: Store, edges: DataFrame) -> DataFrame:
    """Those ends of edges that are nodes."""
    return store.existing("nodes", edges.select(F.col("src").alias("identifier")).unionByName(edges.select(F.col("dst").alias("identifier"))))


def write_edges(store: Store, seen: DataFrame, written: DataFrame, run_id: str) -> tuple[DataFrame, DataFrame]:
    """Stage the edges (EDGES) of a run whose nodes (written: identifier) are staged: those between nodes, deferred ones, and deferred ones of earlier runs whose target is written now.

    Returns what is deferred and what is promoted, written tables. Of the store only those rows are read that have keys of the run.
    """
    seen = write_table(seen, "edges-seen")
    good, waiting = graph.split_by_endpoints(seen, _known(store, seen))
    waiting = write_table(waiting, "edges-pending")
    candidates = write_table(store.fetch("pending", PENDING, written.select(F.col("identifier").alias("dst"))), "edges-candidates")
    promoted = write_table(graph.split_by_endpoints(candidates, _known(store, candidates))[0], "edges-promoted")
    keys = waiting.select(*graph.KEY).distinct()
    before = store.fetch("pending", PENDING, waiting).join(keys, graph.KEY, "left_semi")
    store.upsert("pending", graph.upsert_pending(before, waiting, run_id))
    store.remove("pending", promoted)

    def part(rows: DataFrame, at: int, *order) -> DataFrame:
        return rows.select(*graph.KEY, "props", F.lit(at).alias("_at"), *(order or (F.lit("").alias("doc"), F.lit(0).alias("seq"))))

    given = part(promoted, 1).unionByName(part(good, 2, "doc", "seq"))
    old = store.fetch("edges", KEPT, given)
    merged = graph.merged_props(part(old, 0).unionByName(given), "_at", "doc", "seq")
    store.upsert("edges", merged.select(*graph.KEY, "props", F.lit(run_id).alias("run_id")))
    return waiting, promoted


def apply_batch(store: Store, batch: DataFrame, run_id: str) -> None:
    """One run: batch has node ids (identifier) and edges in one table, as column `e` of EDGES or null. Its cost follows the batch and not the store."""
    nodes = write_table(batch.where("identifier is not null").select("identifier").distinct(), "batch-nodes")
    empty = F.create_map().cast("map<string,string>")
    new = nodes.join(store.existing("nodes", nodes), "identifier", "left_anti")
    store.upsert("nodes", new.select("identifier", F.lit(None).cast("string").alias("label"), empty.alias("props")))
    write_edges(store, batch.where("e is not null").select("e.*"), nodes, run_id)
    store.publish()


def incremental_runs(stream: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Each micro-batch of the stream (identifier, e) is a run; a repeated batch changes nothing but last_seen_run."""
    return stream.writeStream.foreachBatch(lambda batch, n: apply_batch(store, batch, f"run-{n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def over_limit(events: DataFrame, seconds: int, limit: int, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Users and fixed windows with more than `limit` events: user, window_start, n. Batch or stream."""
    counted = events.groupBy(user, F.window(ts, f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n"))
    return counted.where(F.col("n") > limit).select(user, F.col("w.start").alias("window_start"), "n")


def rate_limited_stream(events: DataFrame, seconds: int, limit: int, late: str = "10 minutes") -> DataFrame:
    """over_limit() of an unbounded stream; windows are final once the watermark has passed them."""
    return over_limit(events.withWatermark("ts", late), seconds, limit)
