"""Exact deduplication over a cuckoo-filter index of live digests.

The SHA-256 space is cut into shards by digest. A shard holds a cuckoo filter (four 16-bit
fingerprints to a bucket, partial-key hashing) and, beside it, the full digests in content buckets:
a hit of the filter counts only once a stored digest is equal. An insertion that finds no free slot
after `KICKS` moves doubles the filter, which is filled again from the stored digests. Deletion
removes one fingerprint and its stored digest.

Equal texts are met in one shard. Before they are sent there, each task sums up the equal digests
of a batch, so a text that a third of all rows share comes as a few rows from each task. A task has the
index of one shard at a time, and the number of shards grows with the input.

Null counts as the empty text, so null, empty and all-space texts are one group. Ties go to the smallest
doc_id, and a null doc_id comes last (it stays where a group has no other); repeated rows are members of
their group like any other, and of rows that are equal in all this the first by place stays, so that
exactly one row of a group is kept. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.rows import AT, FILE, numbered, only
from corpusloom.llm.words import SPACE
from corpusloom.llm.workers import trimmed
from corpusloom.session import write_table

SLOTS, KICKS = 4, 200


class CuckooIndex:
    """Live digests (bytes of at least 16) with a value each; membership is exact."""

    def __init__(self, capacity: int = 1024) -> None:
        self.live: dict[int, list[list]] = {}
        self.n = self.resized = self.filter_hits = self.confirmed = 0
        self._size(max(1, capacity))

    def _size(self, capacity: int) -> None:
        self.mask = (1 << max(4, (capacity * 5 // 4 // SLOTS).bit_length())) - 1
        self.table = [0] * ((self.mask + 1) * SLOTS)

    def _keys(self, digest: bytes) -> tuple[int, int]:
        """Fingerprint (never 0, which marks a free slot) and first bucket."""
        return int.from_bytes(digest[:2], "little") or 1, int.from_bytes(digest[4:12], "little") & self.mask

    def _other(self, bucket: int, fp: int) -> int:
        return (bucket ^ (fp * 0x5BD1E995)) & self.mask

    def _place(self, fp: int, bucket: int) -> bool:
        table = self.table
        for b in (bucket, self._other(bucket, fp)):
            for s in range(b * SLOTS, b * SLOTS + SLOTS):
                if not table[s]:
                    table[s] = fp
                    return True
        for kick in range(KICKS):
            s = bucket * SLOTS + (kick + fp) % SLOTS
            fp, table[s] = table[s], fp
            bucket = self._other(bucket, fp)
            for s in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not table[s]:
                    table[s] = fp
                    return True
        return False

    def _grow(self) -> None:
        """A larger filter, filled from the stored digests."""
        stored = [entry for bucket in self.live.values() for entry in bucket]
        factor = 2
        while True:
            self._size(factor * (len(stored) + 1))
            self.resized += 1
            self.live = {}
            for entry in stored:
                fp, bucket = self._keys(entry[0])
                self.live.setdefault(bucket, []).append(entry)
                if not self._place(fp, bucket):
                    break
            else:
                return
            factor *= 2

    def maybe(self, digest: bytes) -> bool:
        """What the filter alone says; false is certain."""
        fp, b = self._keys(digest)
        o = self._other(b, fp)
        return fp in self.table[b * SLOTS : b * SLOTS + SLOTS] or fp in self.table[o * SLOTS : o * SLOTS + SLOTS]

    def find(self, digest: bytes) -> list | None:
        """The entry [digest, value] of a live digest: filter first, then the content bucket."""
        if not self.maybe(digest):
            return None
        self.filter_hits += 1
        for entry in self.live.get(self._keys(digest)[1], ()):
            if entry[0] == digest:
                self.confirmed += 1
                return entry
        return None

    def insert(self, digest: bytes, value) -> None:
        """The digest must not be live."""
        fp, bucket = self._keys(digest)
        self.live.setdefault(bucket, []).append([digest, value])
        self.n += 1
        if not self._place(fp, bucket):
            self._grow()

    def delete(self, digest: bytes) -> bool:
        entry = self.find(digest)
        if entry is None:
            return False
        fp, bucket = self._keys(digest)
        self.live[bucket].remove(entry)
        for b in (bucket, self._other(bucket, fp)):
            for s in range(b * SLOTS, b * SLOTS + SLOTS):
                if self.table[s] == fp:
                    self.table[s] = 0
                    self.n -= 1
                    return True
        raise AssertionError("a live digest has no fingerprint")

    def items(self) -> Iterator[list]:
        for bucket in self.live.values():
            yield from bucket


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in trimmed(batches):
        texts = [t or "" for t in batch["text"].to_pylist()]
        sums = [hashlib.sha256(t.encode().translate(None, SPACE)).digest() for t in texts]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sums, pa.binary()), pa.array([len(t) for t in texts], pa.int64()), batch[FILE], batch[AT]], ["doc_id", "digest", "chars", FILE, AT])


def _digested(every: DataFrame) -> DataFrame:
    """doc_id, digest, chars, FILE, AT of numbered documents."""
    return every.select(F.col("doc_id").cast("long").alias("doc_id"), "text", FILE, AT).mapInArrow(_digest, f"doc_id long, digest binary, chars long, {FILE} long, {AT} long")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest binary (SHA-256 of the text without white space), chars (code points of the text as it is)."""
    nowhere = F.lit(0).cast("long")
    return _digested(docs.select("doc_id", "text", nowhere.alias(FILE), nowhere.alias(AT))).drop(FILE, AT)


#: chars, doc_id, FILE, AT of a row.
Row = tuple[int, int | None, int, int]


def _order(row: Row) -> tuple:
    """Sorts rows of one group, best last: more code points, then the smaller doc_id, then null, then the first place."""
    chars, doc_id, file, at = row
    return chars, doc_id is not None, -(doc_id or 0), -file, -at


_BEST = ("chars", "keep_id", FILE, AT)
_GROUPS = f"digest binary, chars long, keep_id long, {FILE} long, {AT} long, group_size long"


def _as_batch(held: list[tuple[bytes, Row, int]]) -> pa.RecordBatch:
    columns = [pa.array([r[k] for _, r, _ in held], pa.int64()) for k in range(4)]
    return pa.RecordBatch.from_arrays([pa.array([d for d, _, _ in held], pa.binary()), *columns, pa.array([n for _, _, n in held], pa.int64())], ["digest", *_BEST, "group_size"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal digests of one batch as one row: its best row and their number."""
    for batch in batches:
        held: dict[bytes, list] = {}
        columns = (batch[c].to_pylist() for c in ("digest", "chars", "doc_id", FILE, AT))
        for digest, *row in zip(*columns, strict=True):
            if (x := held.get(digest)) is None:
                held[digest] = [row, 1]
            else:
                x[1] += 1
                if _order(row) > _order(x[0]):
                    x[0] = row
        yield _as_batch([(d, row, n) for d, (row, n) in held.items()])


def _flushed(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
    held = []
    for digest, (row, n) in index.items():
        held.append((digest, row, n))
        if len(held) == 10_000:
            yield _as_batch(held)
            held = []
    yield _as_batch(held)


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The live digests of a task's shard, each with the row that stays and the size of its group."""
    index = CuckooIndex()
    for batch in batches:
        for digest, *row, n in zip(*(batch[c].to_pylist() for c in ("digest", *_BEST, "group_size")), strict=True):
            entry = index.find(digest)
            if entry is None:
                index.insert(digest, (row, n))
            else:
                was, m = entry[1]
                entry[1] = (max(row, was, key=_order), m + n)
    yield from _flushed(index)


def _shards(rows: DataFrame, per_shard: int) -> int:
    """So many tasks that none meets more than about per_shard rows, and no fewer than Spark's shuffles have."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // per_shard))


def groups(digested: DataFrame, per_shard: int = 200_000) -> DataFrame:
    """digest, the row that stays (chars, keep_id, FILE, AT), group_size. digested: doc_id, digest, chars, FILE, AT."""
    return digested.mapInArrow(_summed, _GROUPS).repartition(_shards(digested, per_shard), "digest").mapInArrow(_indexed, _GROUPS)


def _same_row(*sides: str) -> Column:
    a, b = sides
    return (F.col(f"{a}{FILE}") == F.col(f"{b}{FILE}")) & (F.col(f"{a}{AT}") == F.col(f"{b}{AT}"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    held = write_table(_digested(numbered(docs.select("doc_id", "text"))[1]), "exact-digests")
    best = groups(held).select("digest", "keep_id", "group_size", F.col(FILE).alias(f"_best{FILE}"), F.col(AT).alias(f"_best{AT}"))
    return held.join(best, "digest").select("doc_id", "keep_id", "group_size", _same_row("", "_best").alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, one of each group, with all columns of docs."""
    docs, every = numbered(docs)
    return only(every, groups(write_table(_digested(every), "exact-digests")))


@dataclass
class LiveIndex:
    """digests: digest, keep_id, group_size. rows: digest, doc_id, chars, n, the live rows with their number; no task ever has all of one digest's."""

    digests: DataFrame
    rows: DataFrame


_CHANGED = "digest binary, keep_id long, group_size long"


def _counted(digested: DataFrame, name: str) -> DataFrame:
    return digested.groupBy("digest", "doc_id", "chars").agg(F.count("*").alias(name))


def _best_of(rows: DataFrame) -> DataFrame:
    """digest, keep_id, group_size of live rows."""
    first = F.max(F.struct("chars", F.col("doc_id").isNotNull().alias("named"), (-F.col("doc_id")).alias("low")))
    return rows.groupBy("digest").agg(first.alias("best"), F.sum("n").alias("group_size")).select("digest", (-F.col("best.low")).alias("keep_id"), "group_size")


def live_index(digested: DataFrame) -> LiveIndex:
    """A stored index of the rows of digests()."""
    rows = write_table(_counted(digested, "n"), "exact-live-rows")
    return LiveIndex(write_table(_best_of(rows), "exact-live"), rows)


def apply_changes(index: LiveIndex, inserted: DataFrame, deleted: DataFrame, per_shard: int = 200_000) -> LiveIndex:
    """The index after deletions and then insertions of rows (each: digests()).

    A deletion takes away one live row of its digest, doc_id and chars; what is not live is not deleted. A digest
    whose last row goes leaves the filter; where the row that stayed goes, the next best takes its place.
    """
    key = ["digest", "doc_id", "chars"]
    parts = [index.rows.select(*key, F.col("n").alias("live"), F.lit(0).alias("gone"), F.lit(0).alias("came"))]
    parts.append(_counted(deleted, "gone").select(*key, F.lit(0).alias("live"), "gone", F.lit(0).alias("came")))
    parts.append(_counted(inserted, "came").select(*key, F.lit(0).alias("live"), F.lit(0).alias("gone"), "came"))
    summed = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(*key).agg(*(F.sum(c).alias(c) for c in ("live", "gone", "came")))
    n = F.greatest(F.col("live") - F.col("gone"), F.lit(0)) + F.col("came")
    rows = write_table(summed.select(*key, n.alias("n"), (n != F.col("live")).alias("changed")), "exact-live-rows")
    touched = rows.where("changed").select("digest").distinct()
    left = rows.where("n > 0").drop("changed")
    now = _best_of(left.join(touched, "digest", "left_semi"))
    changes = touched.join(now, "digest", "left").select("digest", "keep_id", F.coalesce("group_size", F.lit(0)).alias("group_size"), F.lit(True).alias("change"))
    marked = write_table(index.digests.select("digest", "keep_id", "group_size", F.lit(False).alias("change")).unionByName(changes), "exact-changes")

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live = CuckooIndex()
        for batch in batches:  # a task's stored digests come before the changes
            for digest, keep, size, new in zip(*(batch[c].to_pylist() for c in ("digest", "keep_id", "group_size", "change")), strict=True):
                if new and not size:
                    live.delete(digest)
                elif (entry := live.find(digest)) is None:
                    live.insert(digest, (keep, size))
                else:
                    entry[1] = (keep, size)
        held = list(live.items())
        for at in range(0, len(held), 10_000):
            part = held[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in part], pa.binary()), *(pa.array([v[k] for _, v in part], pa.int64()) for k in range(2))], ["digest", "keep_id", "group_size"])

    dealt = marked.repartition(_shards(marked, per_shard), "digest").sortWithinPartitions("change")
    return LiveIndex(write_table(dealt.mapInArrow(change, _CHANGED), "exact-live"), left)
