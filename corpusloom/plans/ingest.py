"""The ingestion run: scan, parse, link, chunk, embed, write, resolve edges, report."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, fields
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import chunking, embedding, graph, links, parsing, sinks, stats
from corpusloom.session import write_table
from corpusloom.sources import tables, xml
from corpusloom.streaming.incremental import KEPT as EDGES
from corpusloom.streaming.incremental import write_edges

UNFORMATTED = "source_identifier string, target_text string, relation_type string, sens string, source string, first_seen_run string, last_seen_run string"


@dataclass(frozen=True)
class RunPlan:
    """What a run does. Outside development nothing is wiped, embedding is on, unconfigured values are dropped and nodes are lean."""

    root: str
    sources: list[str]
    chunks: chunking.ChunkConfig
    development: bool = False
    wipe: bool = False
    embed: bool = True
    skip_unconfigured: bool = True
    hydrate_nodes: bool = False
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)

    def __post_init__(self) -> None:
        if not self.development and (self.wipe or not self.embed or not self.skip_unconfigured or self.hydrate_nodes):
            raise ValueError("only a development run may wipe, skip embedding, keep unconfigured values or hydrate nodes")

    @staticmethod
    def of(parameters: dict) -> RunPlan:
        """From plain parameters; unknown, missing and mistyped ones are listed together."""
        kinds = {"root": str, "sources": (str, type(None)), "max_chars": int, "overlap_chars": int, "development": bool, "wipe": bool, "embed": bool, "skip_unconfigured": bool, "hydrate_nodes": bool}
        needed = ("root", "max_chars", "overlap_chars")
        wrong = [f"unknown: {k}" for k in parameters if k not in kinds] + [f"missing: {k}" for k in needed if k not in parameters]
        wrong += [f"type of {k}" for k, v in parameters.items() if k in kinds and (not isinstance(v, kinds[k]) or isinstance(v, bool) and kinds[k] is int)]
        if wrong:
            raise ValueError("; ".join(wrong))
        rest = {k: v for k, v in parameters.items() if k in {f.name for f in fields(RunPlan)} - {"sources", "chunks"}}
        return RunPlan(sources=tables.resolve_sources(parameters.get("sources")), chunks=chunking.ChunkConfig(parameters["max_chars"], parameters["overlap_chars"]), **rest)


def run(spark: SparkSession, plan: RunPlan, store: sinks.Store, make_client: Callable, dim: int, model: str, facets: DataFrame | None = None) -> dict:
    """Ingest and return the report. facets: what xml.decode_facets() gives, from another source than the files below the plan's root.

    The model that is served, and that of the collection, are checked before anything is wiped, read or written.
    """
    started = datetime.now(UTC)
    undone = store.recover()
    if plan.embed:
        embedding.check_served(make_client, model, dim)
    if plan.wipe:
        store.wipe()
    store.ensure("chunks", model=model, dim=dim)
    try:
        return _run(spark, plan, store, make_client, dim, model, started, xml.scan(spark, plan.root, plan.sources) if facets is None else facets, undone)
    except Exception as broken:
        undone = {event: n + undone[event] for event, n in store.discard().items()}
        store.stage("run_summaries", sinks.replaced(store.read("run_summaries", _summary_schema(spark)), sinks.run_summary(spark, plan.run_id, plan.sources, "failed", undone, started, str(broken)[:500]), "run_id"))
        store.publish()
        raise


def _summary_schema(spark: SparkSession) -> str:
    return "run_id string, sources array<string>, status string, started_at timestamp, ended_at timestamp, counts map<string,bigint>, error_message string"


def _run(spark: SparkSession, plan: RunPlan, store: sinks.Store, make_client: Callable, dim: int, model: str, started: datetime, facets: DataFrame, undone: dict[str, int]) -> dict:
    facets = write_table(facets, "facets")
    skipped = {(r["source"], r["skip"]): r["count"] for r in xml.skipped(facets).collect()}
    parsed = write_table(parsing.parse_all(xml.raw_documents(facets), plan.sources), "parsed")
    docs = parsing.accepted(parsed, plan.skip_unconfigured)
    linked = write_table(links.extract(docs, plan.sources), "linked")
    embedded = embedding.embed(chunking.chunk(linked, plan.chunks), make_client if plan.embed else embedding.null_client(dim), dim, model)
    embedded = write_table(embedded, "embedded")
    # A document of which a file cannot be taken apart or a passage cannot be embedded fails as a whole and is counted with the kind of error; the run goes on without it.
    failures = write_table(xml.failures(facets).unionByName(embedding_failures(embedded)), "failures")
    tally = {(r.phase, r.type): (r.n, *r.example) for r in stats.failure_tally(failures).collect()}
    broken = failures.where("phase = 'embed'").select("identifier").distinct()
    failed = failures.select("identifier").distinct().count()
    if failed:
        linked = write_table(linked.join(broken, "identifier", "left_anti"), "linked")
        embedded = embedded.join(broken.withColumnRenamed("identifier", "parent_identifier"), "parent_identifier", "left_anti").select(*embedded.columns)
    embedded = embedded.drop("error")
    written = linked.select("identifier").distinct()

    documents = linked.select("identifier", "source", "document_type", "nature", "title", "content", "metadata", *(["source_files"] if plan.hydrate_nodes else []))
    # A document that one run brings twice is written once: the last by source, title and content.
    store.stage("documents", sinks.replaced(store.read("documents", documents.schema), documents, "identifier", "source", "title", "content"))
    store.stage("chunks", sinks.replaced_chunks(store.read("chunks", embedded.schema), embedded, written))
    node_rows = graph.node_table(linked, plan.hydrate_nodes)
    store.upsert("nodes", graph.merge_nodes(store.fetch("nodes", node_rows.schema, node_rows), node_rows))
    store.stage("unformatted", graph.upsert_unformatted(store.read("unformatted", UNFORMATTED), links.unformatted(linked), plan.run_id))

    edges = write_table(links.edges(linked, plan.skip_unconfigured), "edges")
    reduced = write_table(graph.reduce_transitively(edges, "doc", "seq"), "edges-reduced")
    waiting, promoted = write_edges(store, reduced, written, plan.run_id)

    refused = {r["reject"]: r["count"] for r in parsed.where("reject is not null").groupBy("reject").count().collect()}
    n_docs, n_edges, n_reduced, n_waiting = linked.count(), edges.count(), reduced.count(), waiting.count()
    counts = {
        "document.fetched": xml.fetched(facets).count(),
        "document.persisted": n_docs,
        "document.invalidated": sum(refused.values()),
        "document.failed": failed,
        "document.version_skipped": sum(n for (_, why), n in skipped.items() if why == "export_artifact"),
        "document.unreadable": sum(n for (_, why), n in skipped.items() if why == "unreadable"),
        "relation.upserted": n_reduced - n_waiting,
        "relation.pending": n_waiting,
        "relation.promoted": promoted.count(),
        "relation.unknown": linked.agg(F.coalesce(F.sum("links.lost"), F.lit(0))).first()[0],
        "chunk.truncated": stats.truncated_chunks(embedded).first()[0],
        **undone,
    }
    seen = (F.lit(counts[f"document.{x}"]) for x in ("fetched", "persisted", "invalidated", "failed"))
    status = spark.range(1).select(stats.status(F.lit("ok"), *seen)).first()[0]
    summary = sinks.run_summary(spark, plan.run_id, plan.sources, status, counts, started)
    store.stage("run_summaries", sinks.replaced(store.read("run_summaries", _summary_schema(spark)), summary, "run_id"))
    store.check_unique()
    store.publish()
    unknown = signals(parsed, linked)
    return {
        "written": n_docs,
        "skipped": skipped,
        "failed": failed,
        "failures": tally,
        "status": status,
        "refused": refused,
        "extracted": n_edges,
        "relations_written": counts["relation.upserted"],
        "relations_pending": n_waiting,
        "relations_reduced": n_edges - n_reduced,
        "relations_promoted": counts["relation.promoted"],
        "unknowns": {r["category"]: [(v["value"], v["n"]) for v in r["values"]] for r in stats.with_all_categories(stats.unknown_tally(unknown)).collect()},
        "collisions": [(r["source"], r["key"], r["n"]) for r in stats.collision_tally(parsing.collision_signals(parsed)).collect()],
        "counts": counts,
    }


def embedding_failures(embedded: DataFrame) -> DataFrame:
    """identifier, phase, type, message of the passages that have no vector."""
    return embedded.where("embedding IS NULL").select(F.col("parent_identifier").alias("identifier"), F.lit("embed").alias("phase"), "error.type", "error.message")


def signals(parsed: DataFrame, linked: DataFrame) -> DataFrame:
    """All unknown values of a run: tags, links (guessed ones and words without a verb) and roots."""
    words = linked.select(F.lit("links").alias("category"), "identifier", F.explode("links.unknown_words").alias("value"), F.element_at("source_files", 1).alias("source_file"))
    return parsing.unknown_signals(parsed).unionByName(words.select("category", "identifier", "value", "source_file"))
