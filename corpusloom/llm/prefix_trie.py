"""Conversations as a tree of their common beginnings.

A node is a distinct sequence of first turns; its members are the conversations that begin with it, and the
smallest member owns it. Who owns a node owns all nodes further down his own path, as their members are fewer and he is among
them. So each conversation owns one chain, from its first owned depth to its end, and a binary search finds that
depth: each round joins one prefix of every undecided conversation with the least member of each prefix that several share,
and drops the half of the prefixes that is ruled out, so that all rounds together read twice what the first one reads. The
chains form the tree, each hanging on the node above its first one. Sums over subtrees go bottom-up over
chains, whose ancestors are met by doubling steps, and then backwards along each chain.

Positions, prefix digests and sums along a chain are running aggregates. A conversation may hold any part of all turns, so
these run within blocks, and each block starts from the aggregate of the blocks before it (`running`).

Digests of a prefix are two 64-bit exclusive ors over hashes of (depth, SHA-256 of the turn).

Turns are ordered by turn, null first; equal ones by the SHA-256 of role and text, so equal rows are so many turns in a row. Null roles and
texts are empty. Rows without a conv_id belong to no conversation and are left out. Texts are read whole and leave the plan
in its first step as a digest and a number of words. Columns besides conv_id, turn, role and text are left out, whatever
their names. No conversation, no node: not even the root.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import drop_table, write_table

#: Turns of one conversation in a block, as a power of two.
BLOCK_BITS = 16
#: Members whose ids one row carries on their way to a digest.
IDS = 1 << 14


def block_of(depth: str | Column) -> Column:
    return F.shiftright(depth, BLOCK_BITS)


def running(rows: DataFrame, key: str, block: str, order: list[Column], aggregates: dict[str, tuple[Column, str]], down: bool = False) -> DataFrame:
    """rows with running aggregates over `key` in `order`, of which blocks are runs; `down` if blocks are passed from the last to the first.

    aggregates: name -> (aggregate, "sum" or "bit_xor", by which those of blocks are put together). No task needs all rows of a key:
    those of a block meet, and then one row for each block.
    """
    within = Window.partitionBy(key, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.select("*", *(a.over(within).alias(name) for name, (a, _) in aggregates.items()))
    totals = rows.groupBy(key, block).agg(*(a.alias(f"_{name}") for name, (a, _) in aggregates.items()))
    before = Window.partitionBy(key).orderBy(F.desc(block) if down else F.asc(block)).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(key, block, *(getattr(F, how)(f"_{name}").over(before).alias(f"_{name}") for name, (_, how) in aggregates.items()))
    carried = carried.where(" AND ".join(f"_{name} IS NOT NULL" for name in aggregates))
    joined = local.join(carried, [key, block], "left")
    both = {name: F.col(name) + F.coalesce(f"_{name}", F.lit(0)) if how == "sum" else F.col(name).bitwiseXOR(F.coalesce(f"_{name}", F.lit(0))) for name, (_, how) in aggregates.items()}
    return joined.select(*rows.columns, *(c.alias(name) for name, c in both.items()))


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """conv_id, at (1 for the first turn), digest, words; a written table."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("words"),
        F.monotonically_increasing_id().alias("_row"),
    )
    turns = write_table(turns, "trie-turns")  # texts are read once, not a second time for the bounds of the ranges
    # Ranges cut a long conversation, and even equal turns of one, into several blocks.
    order = [F.asc_nulls_first("turn"), F.asc("digest"), F.asc("_row")]
    ranged = write_table(turns.repartitionByRange("conv_id", *order).withColumn("_block", F.spark_partition_id()), "trie-ranges")
    placed = running(ranged, "conv_id", "_block", order, {"at": (F.count(F.lit(1)), "sum")})
    placed = write_table(placed.select("conv_id", "at", "digest", "words"), "trie-placed")
    drop_table(turns)
    drop_table(ranged)
    return placed


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, length), a written table; (conv_id, depth, digest, words)): the first h turns of conversation c - c % 20, then c's own after its first h, h = crc32(c) % 4."""
    h = F.crc32(F.col("conv_id").cast("string")) % 4
    counted = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = counted.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 20).alias("base"))
    given = counted.select(F.col("conv_id").alias("base"), F.col("n").alias("_n"))
    convs = convs.join(given, "base", "left").withColumn("k", F.least("h", F.coalesce("_n", F.lit(0))))
    convs = write_table(convs.select("conv_id", "base", "h", "k", "n", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "trie-lengths")
    head = turns.where("at <= 3").select(F.col("conv_id").alias("base"), F.col("at").alias("depth"), "digest", "words")
    taken = convs.where("k > 0").select("conv_id", "base", "k").join(head, "base").where("depth <= k").select("conv_id", "depth", "digest", "words")
    # A conversation meets its turns block by block, so no task gets a long one whole.
    spread = convs.select("conv_id", "h", "k", F.explode(F.sequence(F.lit(0).cast("long"), block_of("n"))).alias("_block"))
    own = turns.where(F.col("at") > h).withColumn("_block", block_of("at")).join(spread, ["conv_id", "_block"])
    return convs, taken.unionByName(own.select("conv_id", (F.col("at") - F.col("h") + F.col("k")).alias("depth"), "digest", "words"))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, d1, d2 (the prefix's digest), words (of its last turn)."""
    hashed = turns.select("conv_id", "depth", "words", block_of("depth").alias("_block"), *(F.xxhash64(F.lit(k), "depth", "digest").alias(f"_x{k}") for k in (1, 2)))
    return running(hashed, "conv_id", "_block", [F.asc("depth")], {f"d{k}": (F.bit_xor(f"_x{k}"), "bit_xor") for k in (1, 2)}).select("conv_id", "depth", "d1", "d2", "words")


def first_owned(paths: DataFrame, lengths: DataFrame, nodes: DataFrame) -> DataFrame:
    """conv_id, length, first, above, of conversations with turns; a written table.

    first: first owned depth, or length + 1 if a conversation owns none. above: who owns the prefix before it, null for the root.
    """
    shared = nodes.where("n_convs > 1").select("depth", "d1", "d2", "owner")  # other prefixes are their only member's
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    begun = lengths.where("length > 0").select("conv_id", "length", F.lit(1).cast("long").alias("lo"), (F.col("length") + 1).alias("hi"), none.alias("above"), F.explode(F.sequence(zero, block_of("length"))).alias("_block"))
    left = paths.select("conv_id", "depth", "d1", "d2", block_of("depth").alias("_block")).join(begun, ["conv_id", "_block"])
    rounds, longest = [], lengths.agg(F.max("length")).first()[0] or 0
    for _ in range(longest.bit_length()):  # lo = hi after so many halvings
        probed = left.where("depth = (lo + hi) DIV 2").join(shared, ["depth", "d1", "d2"], "left")
        owns = F.col("owner").isNull() | (F.col("owner") == F.col("conv_id"))
        said = probed.select(
            "conv_id",
            F.col("depth").alias("probe"),
            F.when(owns, F.col("lo")).otherwise(F.col("depth") + 1).alias("lo"),
            F.when(owns, F.col("depth")).otherwise(F.col("hi")).alias("hi"),
            F.when(owns, F.col("above")).otherwise(F.col("owner")).alias("above"),
            F.explode(F.sequence(block_of("lo"), block_of(F.col("hi") - 1))).alias("_block"),
        )
        # A decided conversation keeps the row that was probed last.
        met = left.drop("lo", "hi", "above").join(said, ["conv_id", "_block"]).where("depth >= lo AND depth < hi OR lo = hi AND depth = probe")
        rounds.append(write_table(met.drop("probe"), "trie-search"))
        left = rounds[-1].where("lo < hi")
    decided = [r.where("lo = hi").select("conv_id", "length", F.col("lo").alias("first"), "above") for r in rounds]
    empty = lengths.where("false").select("conv_id", "length", none.alias("first"), none.alias("above"))
    out = write_table(functools.reduce(DataFrame.unionByName, decided, empty), "trie-decided")
    for r in rounds:
        drop_table(r)
    return out


def subtree_totals(chains: DataFrame, own: DataFrame) -> DataFrame:
    """conv_id, saved, leaves: sums over a chain and all chains below it. chains: conv_id, up (null: none that counts). own: conv_id, saved, leaves.

    After k rounds each chain has the sum over those less than 2**k steps below it; a round adds what those exactly 2**k below have.
    """
    parts, links = [own], chains.where("up IS NOT NULL").select("conv_id", "up")
    written = []
    while not links.isEmpty():
        so_far = functools.reduce(DataFrame.unionByName, parts).join(links, "conv_id").groupBy("up").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
        parts.append(write_table(so_far.withColumnRenamed("up", "conv_id"), "trie-sums"))
        higher = links.select(F.col("conv_id").alias("up"), F.col("up").alias("_up"))
        written.append(write_table(links.join(higher, "up").select("conv_id", F.col("_up").alias("up")), "trie-links"))
        links = written[-1]
    total = write_table(functools.reduce(DataFrame.unionByName, parts).groupBy("conv_id").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")), "trie-totals")
    for t in (*parts[1:], *written):
        drop_table(t)
    return total


def ends_digests(ends: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256 of each node where conversations end. ends: conv_id, depth, member.

    Members are sorted over all tasks, and each task puts up to IDS of a node's into one row; a node's digest then streams over these rows.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held = None, []
        for batch in batches:
            rows = []
            for owner, depth, member in zip(*(batch[c].to_pylist() for c in ("conv_id", "depth", "member")), strict=True):
                if node != (owner, depth) or len(held) == IDS:
                    if held:
                        rows.append((*node, held[0], ",".join(map(str, held))))
                    node, held = (owner, depth), []
                held.append(member)
            yield _batch(rows, [*_NODE, ("first", pa.int64()), ("ids", pa.string())])
        if held:
            yield _batch([(*node, held[0], ",".join(map(str, held)))], [*_NODE, ("first", pa.int64()), ("ids", pa.string())])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            rows = []
            for owner, depth, ids in zip(*(batch[c].to_pylist() for c in ("conv_id", "depth", "ids")), strict=True):
                if node == (owner, depth):
                    digest.update(b"," + ids.encode())
                    continue
                if node:
                    rows.append((*node, digest.hexdigest()))
                node, digest = (owner, depth), hashlib.sha256(ids.encode())
            yield _batch(rows, [*_NODE, ("ends_sha256", pa.string())])
        if node:
            yield _batch([(*node, digest.hexdigest())], [*_NODE, ("ends_sha256", pa.string())])

    order = ["conv_id", "depth", "member"]
    packed = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(joined, "conv_id long, depth long, first long, ids string")
    return packed.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first").mapInArrow(digested, "conv_id long, depth long, ends_sha256 string")


_NODE = [("conv_id", pa.int64()), ("depth", pa.int64())]


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = turns_in_order(conversations)
    lengths, rows = rebuilt(turns)
    paths = write_table(prefixes(rows), "trie-paths")
    drop_table(turns)
    nodes = write_table(paths.groupBy("depth", "d1", "d2").agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words")), "trie-nodes")
    found = first_owned(paths, lengths, nodes)
    drop_table(paths)

    top = lengths.agg(F.min("conv_id").alias("c")).first()["c"]  # the root's owner, whose chain begins at depth 0
    is_top = F.col("conv_id") == F.lit(top)
    above = F.coalesce("above", F.lit(top).cast("long"))
    chains = found.where(~is_top & (F.col("first") <= F.col("length"))).select("conv_id", "length", "first", above.alias("above"))
    top_chain = lengths.where(is_top).select("conv_id", "length", F.lit(0).cast("long").alias("first"), F.lit(None).cast("long").alias("above"))
    every = chains.unionByName(top_chain)
    root = lengths.agg(F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(F.lit(top).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("words"))

    # What a node is told by chains: each that hangs on it is a child; the last of a chain has none in its own; the first has another's node as parent.
    none = F.lit(None).cast("long")
    told = (
        chains.select(F.col("above").alias("conv_id"), (F.col("first") - 1).alias("depth"), F.lit(1).alias("more"), none.alias("parent"))
        .unionByName(every.select("conv_id", F.col("length").alias("depth"), F.lit(-1).alias("more"), none.alias("parent")))
        .unionByName(chains.select("conv_id", F.col("first").alias("depth"), F.lit(0).alias("more"), F.col("above").alias("parent")))
    )
    told = told.groupBy("conv_id", "depth").agg(F.sum("more").alias("more"), F.max("parent").alias("parent"))
    tree = nodes.select(F.col("owner").alias("conv_id"), "depth", "n_convs", "words").unionByName(root).join(told, ["conv_id", "depth"], "left")
    children = F.lit(1) + F.coalesce("more", F.lit(0))
    tree = tree.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id"),
        "n_convs",
        children.alias("n_children"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
        (children == 0).cast("long").alias("leaf"),
    )
    tree = write_table(tree, "trie-tree")

    own = chains.select("conv_id").join(tree.groupBy("conv_id").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaves")), "conv_id")
    own = write_table(own, "trie-own")
    below = subtree_totals(chains.select("conv_id", F.when(F.col("above") != F.lit(top), F.col("above")).alias("up")), own)
    hung = chains.join(below, "conv_id").groupBy(F.col("above").alias("conv_id"), (F.col("first") - 1).alias("depth")).agg(F.sum("saved").alias("_saved"), F.sum("leaves").alias("_leaves"))
    summed = tree.join(hung, ["conv_id", "depth"], "left").withColumns({"_saved": F.col("saved") + F.coalesce("_saved", F.lit(0)), "_leaves": F.col("leaf") + F.coalesce("_leaves", F.lit(0)), "_block": block_of("depth")})
    summed = running(summed, "conv_id", "_block", [F.desc("depth")], {"saved_tokens": (F.sum("_saved"), "sum"), "n_leaves": (F.sum("_leaves"), "sum")}, down=True)

    ends = (
        found.select(F.when(F.col("first") <= F.col("length"), F.col("conv_id")).otherwise(above).alias("owner"), F.col("length").alias("depth"), F.col("conv_id").alias("member"))
        .unionByName(lengths.where("length = 0").select(F.lit(top).cast("long").alias("owner"), F.col("length").alias("depth"), F.col("conv_id").alias("member")))
        .withColumnRenamed("owner", "conv_id")
    )
    nothing = hashlib.sha256(b"").hexdigest()
    whole = summed.join(ends_digests(ends), ["conv_id", "depth"], "left")
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
