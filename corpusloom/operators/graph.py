"""The graph phase: reduction of containment, upserts with endpoint checks, deferred edges, promotion."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from corpusloom.operators.links import CONTIENT
from corpusloom.session import drop_table, write_table

KEY = ["src", "dst", "type"]
#: Edges of a component that one task reduces at once; larger ones are searched by joins.
SMALL = 2048
#: Pairs of nodes that a task holds at once, about.
REACH_CELLS = 1 << 22
#: Rounds in which trees of one component are put together; what is not whole then is searched by joins.
MERGE_ROUNDS = 6


def first_edges(edges: DataFrame, *order: str) -> DataFrame:
    """Of each (src, dst) the first edge by the columns of `order`, which must be a total order."""
    w = Window.partitionBy("src", "dst").orderBy(*order)
    return edges.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def _jumped(steps: DataFrame) -> DataFrame | None:
    """x, nxt of a written table of single steps, each led on to where no step begins; None if some never get there, as they run in a circle."""
    rounds = steps.count().bit_length() // 2 + 1
    for _ in range(rounds):
        more = steps.select(F.col("x").alias("nxt"), F.col("nxt").alias("_nxt"))
        far = steps.select("x", "nxt")
        for _ in range(3):  # four steps of the table a round
            far = far.join(more, "nxt", "left").select("x", F.coalesce("_nxt", "nxt").alias("nxt"), F.col("_nxt").isNotNull().alias("moved"))
        far = write_table(far, "graph-jumps")
        drop_table(steps)
        steps = far
        if steps.where("moved").isEmpty():
            return steps
    drop_table(steps)
    return None


def _contracted(edges: DataFrame, all_ends: bool) -> tuple[DataFrame, list[DataFrame], bool]:
    """(core, tables of all rounds, whether a cycle was met) of a written table src, dst, long.

    Nodes with one edge in and one out give way to a longer edge, whole chains at once; nodes with but one edge go with it,
    and under all_ends all that have edges on one side only. What is left has forks and joins throughout, whatever the depth of the rest. An edge
    beside a longer one of the same ends is `beaten`. Cycles stay, as loops at last.
    """
    rounds = [edges]
    while True:
        n, loops = edges.agg(F.count(F.lit(1)), F.count_if(F.col("src") == F.col("dst"))).first()
        if loops or not n:
            return edges, rounds, bool(loops)
        sides = edges.select(F.col("src").alias("x"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select(F.col("dst").alias("x"), F.lit(1).alias("i"), F.lit(0).alias("o")))
        nodes = sides.groupBy("x").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
        gone = write_table(nodes.where("i <= 1 AND o <= 1" + (" OR i = 0 OR o = 0" if all_ends else "")), "graph-gone")
        if gone.isEmpty():
            drop_table(gone)
            return edges, rounds, False
        passed = gone.where("i = 1 AND o = 1").select(F.col("x").alias("src"))
        steps = write_table(edges.join(passed, "src").select(F.col("src").alias("x"), F.col("dst").alias("nxt")), "graph-steps")
        steps = _jumped(steps)
        if steps is None:
            drop_table(gone)
            return edges, rounds, True
        kept = edges.select("src", "dst", "long").join(gone.select(F.col("x").alias("src")), "src", "left_anti")
        kept = kept.join(steps.select(F.col("x").alias("dst"), "nxt"), "dst", "left").select("src", F.coalesce("nxt", "dst").alias("dst"), (F.col("long") | F.col("nxt").isNotNull()).alias("long"))
        kept = kept.join(gone.where("NOT (i = 1 AND o = 1)").select(F.col("x").alias("dst")), "dst", "left_anti")
        edges = write_table(kept.groupBy("src", "dst").agg(F.max("long").alias("long"), (F.min("long") != F.max("long")).alias("beaten")), "graph-core")
        rounds.append(edges)
        drop_table(gone)
        drop_table(steps)


def _pairs(pairs: DataFrame) -> DataFrame:
    return write_table(pairs.select("src", "dst").dropna().distinct().withColumns({"long": F.lit(False), "beaten": F.lit(False)}), "graph-edges")


def _cyclic(edges: DataFrame) -> bool:
    """Whether a written table src, dst, long has a cycle: with all ends gone, nothing is left of an acyclic graph."""
    core, rounds, loop = _contracted(edges, True)
    found = loop or not core.isEmpty()
    for t in rounds[1:]:
        drop_table(t)
    return found


def has_cycle(pairs: DataFrame) -> bool:
    """Whether the edges (src, dst) have a cycle. A self-loop is one."""
    edges = _pairs(pairs)
    found = _cyclic(edges)
    drop_table(edges)
    return found


def _replaced_in_core(core: DataFrame) -> list[DataFrame]:
    """Written tables (dst, src) that hold all edges of an acyclic core which a longer path replaces.

    Only edges whose source has another one out and whose target another one in come into question. From their targets the search goes
    backwards, and stops for a target whose edges are all found to be replaced; its rounds are the core's depth at most.
    """
    forks, joins = (core.groupBy(c).count().where("count > 1").select(c) for c in ("src", "dst"))
    asked = write_table(core.where("NOT long").join(forks, "src", "left_semi").join(joins, "dst", "left_semi").select("src", "dst"), "graph-asked")
    first = write_table(core.join(asked.select("dst").distinct(), "dst", "left_semi").select("dst", "src"), "graph-above")
    back = core.select(F.col("dst").alias("src"), F.col("src").alias("_up"))
    found, seen, above, still = [], [first], first, asked
    while not above.isEmpty():
        # All that is met by two steps or more; a source that is met has a longer path, though it is one step above, too.
        up = write_table(above.join(back, "src").select("dst", F.col("_up").alias("src")).distinct(), "graph-up")
        found.append(write_table(up.join(still, ["dst", "src"], "left_semi"), "graph-found"))
        open_ = write_table(still.join(up, ["dst", "src"], "left_anti"), "graph-asked")
        fresh = write_table(up.join(reduce(DataFrame.unionByName, seen), ["dst", "src"], "left_anti"), "graph-above")
        drop_table(up)
        drop_table(still)
        still = open_
        seen.append(fresh)
        if len(seen) > 8:
            whole = write_table(reduce(DataFrame.unionByName, seen), "graph-above")
            for t in seen[:-1]:
                drop_table(t)
            seen = [whole]
        above = fresh.join(still.select("dst").distinct(), "dst", "left_semi")
    for t in (*seen, still):
        drop_table(t)
    return found


def _longer_paths(u: np.ndarray, v: np.ndarray, part: np.ndarray, n: int) -> np.ndarray | None:
    """Which edges a longer path replaces; None if there is a cycle. u, v: ends, as numbers below n; part: an edge's component, numbered from 0.

    Nodes are taken by the length of the longest path to them, so that all above a node is known when its turn comes. A component has a table of its own nodes.
    """
    of = np.empty(n, np.int64)
    of[u], of[v] = part, part
    order = np.argsort(of, kind="stable")
    size = np.bincount(of)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
    row = (np.cumsum(size * size) - size * size)[of] + place * size[of]

    out = np.argsort(u, kind="stable")
    begin = np.searchsorted(u[out], np.arange(n + 1))
    waits, level, met = np.bincount(v, minlength=n), np.zeros(n, np.int64), 0
    now = np.flatnonzero(waits == 0)
    while len(now):
        met += len(now)
        count = begin[now + 1] - begin[now]
        below = v[out[np.repeat(begin[now] - np.cumsum(count) + count, count) + np.arange(count.sum())]]
        step = level[now[0]] + 1
        np.subtract.at(waits, below, 1)
        now = np.unique(below[waits[below] == 0])
        level[now] = step
    if met < n:
        return None

    above, longer = np.zeros((size * size).sum(), bool), np.zeros(len(u), bool)
    turn = np.argsort(level[v], kind="stable")
    ends = np.searchsorted(level[v][turn], np.arange(1, level.max() + 2))
    for first, last in zip(ends, ends[1:]):
        edges = turn[first:last]
        width = size[part[edges]]
        for some in np.split(np.arange(len(edges)), np.flatnonzero(np.diff(np.cumsum(width) // REACH_CELLS)) + 1):
            w, e = width[some], edges[some]
            at = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
            has = above[np.repeat(row[u[e]], w) + at]
            above[(np.repeat(row[v[e]], w) + at)[has]] = True
        cell = row[v[edges]] + place[u[edges]]
        longer[edges] = above[cell]
        above[cell] = True
    return longer


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """src, dst of the edges that a longer path replaces; a row of nulls for a cycle. batches: src, dst, part, sorted by part, whose components are whole and small."""

    def found(edges: pa.Table) -> Iterator[pa.RecordBatch]:
        part = edges["part"].combine_chunks().dictionary_encode().indices.to_numpy()
        held = np.bincount(part)
        group = (np.cumsum((held + 1) ** 2) // REACH_CELLS)[part]
        for rows in np.split(np.arange(len(part)), np.flatnonzero(np.diff(group)) + 1):
            src, dst = (edges[c].slice(rows[0], len(rows)).combine_chunks() for c in ("src", "dst"))
            names = pa.concat_arrays([src, dst]).dictionary_encode()
            u, v = np.split(names.indices.to_numpy().astype(np.int64), 2)
            longer = _longer_paths(u, v, (part[rows] - part[rows[0]]).astype(np.int64), len(names.dictionary))
            if longer is None:
                yield pa.RecordBatch.from_arrays([pa.nulls(1, src.type), pa.nulls(1, dst.type)], ["src", "dst"])
            elif longer.any():
                yield pa.RecordBatch.from_arrays([src.filter(pa.array(longer)), dst.filter(pa.array(longer))], ["src", "dst"])

    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n > 64 * SMALL:
            edges = pa.Table.from_batches(held)
            # The last component may go on in the next batch.
            part = edges["part"].combine_chunks().dictionary_encode().indices.to_numpy()
            whole = int(np.searchsorted(part, part[-1]))
            yield from found(edges.slice(0, whole)) if whole else ()
            held = edges.slice(whole).to_batches()
            n -= whole
    if held:
        yield from found(pa.Table.from_batches(held))


def _by_component(edges: DataFrame) -> tuple[DataFrame, DataFrame | None] | None:
    """(edges that a longer path replaces, a written table; a written table of the edges that are still to be searched) of a written table; None if a cycle was met.

    A node's first edge up leads to a top; nodes of one top are a tree, and trees that other edges link are put together. Components of at most SMALL edges are reduced in a
    task each, many at once. Nothing is labelled where components must be larger on the average, as there are so few nodes without an edge up.
    """
    tops = edges.select("src").distinct().join(edges.select(F.col("dst").alias("src")), "src", "left_anti").count()
    n = edges.count()
    if n > SMALL * tops:
        return (None, edges) if tops else None
    if not n:
        return None, None
    tree = _jumped(write_table(edges.groupBy(F.col("dst").alias("x")).agg(F.min("src").alias("nxt")), "graph-tree"))
    if tree is None:
        return None

    def renamed(rows: DataFrame, c: str, by: DataFrame) -> DataFrame:
        return rows.join(by.select(F.col("x").alias(c), F.col("nxt").alias("_nxt")), c, "left").withColumn(c, F.coalesce("_nxt", c)).drop("_nxt")

    marked = edges.select("src", "dst", F.col("src").alias("part"), F.col("dst").alias("other"))
    marked = write_table(renamed(renamed(marked, "part", tree), "other", tree), "graph-marked")
    drop_table(tree)

    def linked(rows: DataFrame) -> DataFrame:
        ends = rows.where("part <> other").select(F.least("part", "other").alias("part"), F.greatest("part", "other").alias("other"))
        return write_table(ends.distinct(), "graph-links")

    links, names, spent = linked(marked), None, []
    for _ in range(MERGE_ROUNDS):
        if links.isEmpty():
            break
        lower = _jumped(write_table(links.groupBy(F.col("other").alias("x")).agg(F.min("part").alias("nxt")), "graph-tree"))
        both = lower.select("x", "nxt") if names is None else renamed(names, "nxt", lower).unionByName(lower.select("x", "nxt"))
        spent += [t for t in (links, names, lower) if t is not None]
        names = write_table(both.select("x", "nxt"), "graph-names")
        links = linked(renamed(renamed(links, "part", lower), "other", lower))
    if names is not None:
        spent.append(marked)
        marked = write_table(renamed(marked, "part", names).select("src", "dst", "part"), "graph-marked")
        spent.append(names)
    open_ = links.select("part").unionByName(links.select(F.col("other").alias("part")))
    large = write_table(marked.groupBy("part").count().where(F.col("count") > SMALL).select("part").unionByName(open_).distinct(), "graph-large")
    rest, small = None, marked.select("src", "dst", "part")
    if not large.isEmpty():
        rest = write_table(marked.join(large, "part", "left_semi").select("src", "dst", F.lit(False).alias("long"), F.lit(False).alias("beaten")), "graph-edges")
        small = small.join(large, "part", "left_anti").select("src", "dst", "part")
    found = write_table(small.repartition("part").sortWithinPartitions("part").mapInArrow(_reduced, StructType([StructField(f.name, f.dataType) for f in edges.select("src", "dst").schema])), "graph-found")
    for t in (*spent, links, marked, large):
        drop_table(t)
    if found.where("src IS NULL").isEmpty():
        return found, rest
    for t in (found, rest):
        if t is not None:
            drop_table(t)
    return None


def redundant(pairs: DataFrame, once: bool = False) -> DataFrame | None:
    """Edges (src, dst) that a longer path replaces, a written table; None if there is a cycle anywhere. once: pairs is a written table without repeats."""
    edges = pairs.select("src", "dst").dropna()
    mine = [] if once else [write_table(edges.distinct(), "graph-edges")]
    edges = mine[0] if mine else edges
    found, parts = None, _by_component(edges)
    if parts is not None:
        local, rest = parts
        mine += [] if local is None else [local]
        tables = [] if local is None else [local.select("src", "dst")]
        whole = True
        if rest is not None:
            core, rounds, loop = _contracted(_pairs(edges) if rest is edges else rest, False)
            whole = not loop and not _cyclic(core)
            if whole:
                deep = _replaced_in_core(core)
                tables += [t.select("src", "dst") for t in (*(t.where("beaten") for t in rounds), *deep)]
                mine += deep
            mine += rounds
        if whole:
            found = write_table(reduce(DataFrame.unionByName, tables) if tables else edges.limit(0), "graph-redundant")
    for t in mine:
        drop_table(t)
    return found


def reduce_transitively(edges: DataFrame, *order: str) -> DataFrame:
    """Containment edges without those that a longer path replaces, and without repeats; with a cycle anywhere only without repeats. Other verbs pass as they are."""
    contained = write_table(first_edges(edges.where(F.col("type") == CONTIENT), *order), "graph-contained")
    others = edges.where(F.col("type") != CONTIENT)
    replaced = redundant(contained, once=True)
    if replaced is not None:
        contained = contained.join(replaced, ["src", "dst"], "left_anti")
    return others.unionByName(contained.select(*others.columns))


def merged_props(edges: DataFrame, *order: str) -> DataFrame:
    """One row for each (src, dst, type); of a property given twice the later one by `order` holds.

    Properties are picked one by one, so an edge that is given often is summed up before it moves.
    """
    given = edges.select(*KEY, *order, F.explode_outer("props").alias("k", "v"))
    last = given.groupBy(*KEY, "k").agg(F.max_by("v", F.struct(*order)).alias("v"))
    entries = F.filter(F.collect_list(F.struct("k", "v")), lambda e: e.k.isNotNull())
    return last.groupBy(*KEY).agg(F.map_from_entries(entries).alias("props"))


def split_by_endpoints(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(written: both ends are nodes, pending: the rest). nodes: identifier. Together they are the input."""
    ids = nodes.select("identifier").distinct()
    has_src = ids.select(F.col("identifier").alias("src"), F.lit(True).alias("_src"))
    has_dst = ids.select(F.col("identifier").alias("dst"), F.lit(True).alias("_dst"))
    marked = edges.join(has_src, "src", "left").join(has_dst, "dst", "left")
    both = F.col("_src").isNotNull() & F.col("_dst").isNotNull()
    return marked.where(both).select(*edges.columns), marked.where(~both).select(*edges.columns)


def upsert_pending(old: DataFrame, seen: DataFrame, run_id: str) -> DataFrame:
    """Pending edges by key; the first run that saw one stays, all else is overwritten. old: src, dst, type, source, props, first_seen_run, last_seen_run."""
    new = seen.groupBy(*KEY).agg(F.max_by(F.struct("source", "props"), F.struct("doc", "seq")).alias("now"))
    held = old.withColumnRenamed("source", "_source").withColumnRenamed("props", "_props")
    both = held.join(new, KEY, "full_outer")
    return both.select(
        *KEY,
        F.coalesce("now.source", "_source").alias("source"),
        F.when(F.col("now").isNotNull(), F.col("now.props")).otherwise(F.col("_props")).alias("props"),
        F.coalesce("first_seen_run", F.lit(run_id)).alias("first_seen_run"),
        F.when(F.col("now").isNotNull(), F.lit(run_id)).otherwise(F.col("last_seen_run")).alias("last_seen_run"),
    )


def promotable(pending: DataFrame, written_ids: DataFrame) -> DataFrame:
    """Pending edges whose target was written in this run. written_ids: identifier."""
    return pending.join(written_ids.select(F.col("identifier").alias("dst")).distinct(), "dst", "left_semi").select(*pending.columns)


def promote(pending: DataFrame, written_ids: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(promoted edges, what is still pending)."""
    promoted, _ = split_by_endpoints(promotable(pending, written_ids), nodes)
    return promoted, pending.join(promoted.select(*KEY), KEY, "left_anti").select(*pending.columns)


def upsert_unformatted(old: DataFrame, seen: DataFrame, run_id: str) -> DataFrame:
    """Described targets by (source_identifier, target_text, relation_type, sens)."""
    key = ["source_identifier", "target_text", "relation_type", "sens"]
    new = seen.groupBy(*key).agg(F.max("source").alias("_new"))
    both = old.join(new, key, "full_outer")
    return both.select(*key, F.coalesce("_new", "source").alias("source"), F.coalesce("first_seen_run", F.lit(run_id)).alias("first_seen_run"), F.when(F.col("_new").isNotNull(), F.lit(run_id)).otherwise(F.col("last_seen_run")).alias("last_seen_run"))


def first_seen_in(table: DataFrame, run_id: str, source: Column | None = None) -> DataFrame:
    """Rows that compensation of a run removes: first seen in it (and of one source, if given)."""
    mine = F.col("first_seen_run") == run_id
    return table.where(mine if source is None else mine & (F.col("source_identifier") == source))


def without_run(edges: DataFrame, run_id: str) -> DataFrame:
    return edges.where(F.col("run_id") != run_id)


def without_source(edges: DataFrame, identifier: str) -> DataFrame:
    return edges.where(F.col("src") != identifier)


def node_table(docs: DataFrame, hydrated: bool) -> DataFrame:
    """identifier, label, props: title and source, or with metadata (whose keys win), text and files."""
    props = F.create_map(F.lit("title"), F.col("title"), F.lit("source"), F.col("source"))
    if hydrated:
        more = F.transform_values("metadata", lambda k, v: F.array_join(v.vals, "; "))
        text = F.create_map(F.lit("text"), F.col("content"), F.lit("source_files"), F.array_join("source_files", "; "))
        props = overlaid(overlaid(props, more), text)
    return docs.select("identifier", F.initcap("document_type").alias("label"), props.alias("props"))


def overlaid(low: Column, high: Column) -> Column:
    """Both maps' entries; where both have a key, that of high."""
    return F.map_concat(F.map_filter(low, lambda k, v: ~F.map_contains_key(high, k)), high)


def merge_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes by identifier; new properties are laid over old ones and none is cleared. Of repeated new nodes the later one by label and properties wins, key by key."""
    given = new.select("identifier", "label", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("props")))).alias("_order"), F.explode_outer("props").alias("k", "v"))
    last = given.groupBy("identifier", "k").agg(F.max_by("v", F.struct("label", "_order")).alias("v"), F.max("label").alias("label"))
    entries = F.filter(F.collect_list(F.struct("k", "v")), lambda e: e.k.isNotNull())
    new = last.groupBy("identifier").agg(F.max("label").alias("label"), F.map_from_entries(entries).alias("props"))
    both = old.withColumnRenamed("props", "_old").withColumnRenamed("label", "_label").join(new, "identifier", "full_outer")
    empty = F.create_map().cast("map<string,string>")
    return both.select("identifier", F.coalesce("label", "_label").alias("label"), overlaid(F.coalesce("_old", empty), F.coalesce("props", empty)).alias("props"))
