"""Stores as Parquet tables: a run writes beside what is there and publishes all at once.

Snapshots are written whole. Keyed tables (`KEYED`) take changes: a change is a part of its own, so writing costs what it brings. Parts
are merged on read, the last change of a key holding. Once there are RAW parts they are merged into one that is dealt over buckets by
the key's hash, and merged parts of like size into a larger one, so there are few, and a row is rewritten as often as the logarithm of the table.
Looking up keys reads the raw parts and, of merged ones, the buckets of these keys alone.
"""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from corpusloom.functions import text as T

DATA_TABLES = ("documents", "chunks", "nodes", "edges", "pending", "unformatted")
#: Never wiped with the data.
META_TABLES = ("run_summaries",)
#: What may be in a table once.
UNIQUE = {"documents": ("identifier",), "chunks": ("chunk_id",), "nodes": ("identifier",), "edges": ("src", "dst", "type"), "pending": ("src", "dst", "type"), "unformatted": ("source_identifier", "target_text", "relation_type", "sens")}


#: Tables that take changes: the key, and the columns by whose hash they are dealt and looked up.
KEYED = {"nodes": (("identifier",), ("identifier",)), "edges": (("src", "dst", "type"), ("src", "dst", "type")), "pending": (("src", "dst", "type"), ("dst",))}
#: Parts of a keyed table that lie as they were written, at most.
RAW = 8


class Store:
    """Named tables below one root. `publish` writes one small manifest under the next number, by a rename, and readers take the highest, so a run is seen whole or not at all, wherever it stops."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, keyed: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = KEYED, keep: int = 5) -> None:
        """buckets: for merged parts that are written from now on; those that are there keep theirs. keyed: tables that take changes. keep: manifests that stay, with what they name, for those who read them still."""
        self.spark, self.root, self.buckets, self.keyed, self.keep = spark, root.rstrip("/"), buckets, keyed, keep
        self.staged: dict[str, str | list[dict]] = {}
        self.run, self.intents = uuid.uuid4().hex, 0
        self.promised: dict[str, dict] = {}

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return jvm, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        """Of the manifests that are there."""
        jvm, fs = self._fs()
        return sorted(int(f.getPath().getName()[9:-5]) for f in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest-*.json")) or [])

    def _read(self, number: int) -> dict[str, dict]:
        return json.loads(self._read_text(f"{self.root}/manifest-{number}.json"))

    def _newest(self) -> dict[str, dict]:
        numbers = self._numbers()
        return self._read(numbers[-1]) if numbers else {"tables": {}, "contracts": {}}

    def _forget(self) -> None:
        """Delete manifests but the newest `keep`, and the folders that only these name."""
        numbers = self._numbers()
        old, kept = numbers[: -self.keep], {at for n in numbers[-self.keep :] for at in _folders(self._read(n)["tables"])}
        for n in old:
            for at in _folders(self._read(n)["tables"]) - kept:
                self._delete(at)
            self._delete(f"{self.root}/manifest-{n}.json")

    def manifest(self) -> dict[str, str | list[dict]]:
        """Name -> folder of the published tables, or the parts of keyed ones."""
        return self._newest()["tables"]

    def ensure(self, name: str, **contract) -> None:
        """A collection with its contract, as a model and a dimension: made with the next publish if it is absent; another contract than the one that it has is an error, before anything is written."""
        held = self._newest()["contracts"].get(name, contract)
        if held != contract:
            raise ValueError(f"{name} was made with {held}, not with {contract}")
        self.promised[name] = contract

    def _replace(self, tables: dict[str, str], contracts: dict[str, dict]) -> None:
        jvm, fs = self._fs()
        number = max(self._numbers(), default=0) + 1
        temporary = jvm.org.apache.hadoop.fs.Path(f"{self.root}/.manifest-{uuid.uuid4().hex}")
        self._write_text(temporary.toString(), json.dumps({"tables": tables, "contracts": contracts}))
        if not fs.rename(temporary, jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest-{number}.json")):
            raise RuntimeError(f"another run has published manifest {number}")

    def exists(self, name: str) -> bool:
        return name in self.manifest()

    def read(self, name: str, schema: str) -> DataFrame:
        """The published table, or an empty one of the schema."""
        at = self.manifest().get(name)
        if name in self.keyed:
            return self._last(name, [self._part(p, schema) for p in at or []], schema)
        return self.spark.read.schema(schema).parquet(at) if at else self.spark.createDataFrame([], schema)

    # ---- compensation: what a run is about to write is noted before, and undone if the run is not published

    def _write_text(self, path: str, text: str) -> None:
        jvm, fs = self._fs()
        out = fs.create(jvm.org.apache.hadoop.fs.Path(path), True)
        out.write(bytearray(text.encode()))
        out.close()

    def _read_text(self, path: str) -> str:
        jvm, fs = self._fs()
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(path))
        text = bytes(stream.readAllBytes()).decode()
        stream.close()
        return text

    def _intend(self, name: str) -> str:
        """A new folder for a table, noted as this run's."""
        at = f"{self.root}/{name}/{uuid.uuid4().hex}"
        self._write_text(f"{self.root}/intents/{self.run}/{self.intents:06d}", at)
        self.intents += 1
        return at

    def _undo(self, run: str) -> dict[str, int]:
        """Delete what a run has written and not published, the last first; what cannot be deleted is counted and keeps its note, so that the next start tries again."""
        jvm, fs = self._fs()
        counts = {"saga.compensation.triggered": 0, "saga.compensation.completed": 0, "saga.compensation.failed": 0}
        held = _folders(self.manifest())
        notes = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.root}/intents/{run}/*")) or []
        for note in sorted((f.getPath() for f in notes), key=lambda p: p.getName(), reverse=True):
            at = self._read_text(note.toString())
            if at not in held and fs.exists(jvm.org.apache.hadoop.fs.Path(at)):
                counts["saga.compensation.triggered"] += 1
                try:
                    self._delete(at)
                except Exception:  # noqa: BLE001  an undo that fails stops no other
                    counts["saga.compensation.failed"] += 1
                    continue
                counts["saga.compensation.completed"] += 1
            fs.delete(note, False)
        if not counts["saga.compensation.failed"]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.root}/intents/{run}"), True)
        return counts

    def _delete(self, at: str) -> None:
        jvm, fs = self._fs()
        fs.delete(jvm.org.apache.hadoop.fs.Path(at), True)

    def recover(self) -> dict[str, int]:
        """Undo what runs left that were stopped before they published. For the start of a run: a store takes one run at a time."""
        jvm, fs = self._fs()
        total = {"saga.compensation.triggered": 0, "saga.compensation.completed": 0, "saga.compensation.failed": 0}
        for f in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.root}/intents/*")) or []:
            if f.getPath().getName() != self.run:
                for event, n in self._undo(f.getPath().getName()).items():
                    total[event] += n
        return total

    def stage(self, name: str, df: DataFrame, *partition: str) -> DataFrame:
        at = self._intend(name)
        df.write.partitionBy(*partition).parquet(at) if partition else df.write.parquet(at)
        self.staged[name] = at
        return self.spark.read.schema(df.schema).parquet(at)

    # ---- keyed tables

    def _parts(self, name: str) -> list[dict]:
        """With those that are staged."""
        return self.staged.get(name, self.manifest().get(name, []))

    def _part(self, part: dict, schema, keys: DataFrame | None = None, name: str | None = None) -> DataFrame:
        fields = schema if isinstance(schema, StructType) else self.spark.createDataFrame([], schema).schema
        rows = self.spark.read.schema(StructType([*fields.fields, StructField("_seq", LongType()), StructField("_gone", BooleanType()), *([StructField("_bucket", IntegerType())] if part["buckets"] else [])])).parquet(part["at"])
        if part["buckets"] and keys is not None:
            touched = keys.select(_bucket(self.keyed[name][1], part["buckets"]).alias("b")).distinct().collect()
            rows = rows.where(F.col("_bucket").isin([r.b for r in touched]))
        return rows.drop("_bucket")

    def _last(self, name: str, parts: list[DataFrame], schema, gone: bool = False) -> DataFrame:
        """The last change of each key; without deleted ones unless `gone`, which has _seq and _gone, too."""
        if not parts:
            empty = self.spark.createDataFrame([], schema)
            return empty.withColumns({"_seq": F.lit(0).cast("long"), "_gone": F.lit(False)}) if gone else empty
        rows = reduce(DataFrame.unionByName, parts)
        last = rows.groupBy(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(self.keyed[name][0]))).agg(F.max_by(F.struct(*rows.columns), "_seq").alias("_row")).select("_row.*")
        return last if gone else last.where("NOT _gone").drop("_seq", "_gone")

    def fetch(self, name: str, schema, keys: DataFrame) -> DataFrame:
        """Rows of a keyed table, staged changes included, whose lookup columns are in keys."""
        by = list(self.keyed[name][1])
        keys = keys.select(*by).distinct()
        found = [self._part(p, schema, keys, name).join(keys, by, "left_semi") for p in self._parts(name)]
        return self._last(name, found, schema)

    def existing(self, name: str, keys: DataFrame, kind: str = "string") -> DataFrame:
        """Those of keys (the lookup columns, of one type) that a keyed table has."""
        key, by = self.keyed[name]
        return self.fetch(name, ", ".join(f"{c} {kind}" for c in dict.fromkeys((*key, *by))), keys).select(*by).distinct()

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Stage rows in place of those of the same key. Each key must be there once."""
        self._add(name, rows.withColumn("_gone", F.lit(False)))

    def remove(self, name: str, rows: DataFrame) -> None:
        """Stage the removal of the rows' keys."""
        self._add(name, rows.withColumn("_gone", F.lit(True)))

    def _add(self, name: str, rows: DataFrame) -> None:
        parts = self._parts(name)
        seq = 1 + max((p["seq"] for p in parts), default=0)
        at = self._intend(name)
        rows.withColumn("_seq", F.lit(seq).cast("long")).select(*(c for c in rows.columns if c != "_gone"), "_seq", "_gone").write.parquet(at)
        self.staged[name] = [*parts, {"at": at, "seq": seq, "buckets": 0, "rows": 0}]

    def merge(self, name: str, least: int = 1) -> None:
        """Merge raw parts if there are `least`, and merged ones while the last is no smaller than a quarter of the one before it."""
        parts = self._parts(name)
        raw = [p for p in parts if not p["buckets"]]
        if len(raw) < least:
            return
        schema = StructType([f for f in self.spark.read.parquet(raw[-1]["at"]).schema.fields if f.name not in ("_seq", "_gone")])
        kept = [p for p in parts if p["buckets"]]
        group, n = raw, sum(self.spark.read.parquet(p["at"]).count() for p in raw)
        while kept and 4 * n >= kept[-1]["rows"]:
            group, n = [kept[-1], *group], n + kept[-1]["rows"]
            kept = kept[:-1]
        rows = self._last(name, [self._part(p, schema) for p in group], schema, gone=True)
        rows = rows if kept else rows.where("NOT _gone")  # nothing older is left that a removal could hide
        at = self._intend(name)
        by = _bucket(self.keyed[name][1], self.buckets)
        rows.withColumn("_bucket", by).repartition("_bucket").sortWithinPartitions("_bucket", *self.keyed[name][0]).write.partitionBy("_bucket").parquet(at)
        self.staged[name] = [*kept, {"at": at, "seq": group[-1]["seq"], "buckets": self.buckets, "rows": n}]

    def publish(self) -> None:
        for name in self.staged.keys() & self.keyed.keys():
            self.merge(name, RAW)
        newest = self._newest()
        self._replace(newest["tables"] | self.staged, newest["contracts"] | self.promised)
        self.staged, self.promised = {}, {}
        self._undo(self.run)  # parts that were merged before they were published, and the notes
        self._forget()

    def discard(self) -> dict[str, int]:
        """Undo what a failed run has staged, the last first; how many undos there were, and how many failed."""
        self.staged, self.promised = {}, {}
        return self._undo(self.run)

    def check_unique(self) -> None:
        """An error if a staged table has a key more than once: then nothing is published."""
        paths = [(name, at if isinstance(at, str) else at[-1]["at"]) for name, at in self.staged.items() if name in UNIQUE]  # of keyed tables what was added last
        wrong = [duplicates(self.spark.read.parquet(at), *UNIQUE[name]).select(F.lit(name).alias("name"), F.concat_ws(" ", *UNIQUE[name]).alias("key")) for name, at in paths]
        found = reduce(DataFrame.unionByName, wrong).take(3) if wrong else []
        if found:
            raise ValueError("more than once: " + ", ".join(f"{r.name} {r.key}" for r in found))

    def wipe(self) -> None:
        """Drop the data tables and contracts; the run summaries stay. The manifest goes first, so that it never names what is not there."""
        self._replace({k: v for k, v in self.manifest().items() if k in META_TABLES}, {})
        jvm, fs = self._fs()
        for name in DATA_TABLES:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}"), True)


def _folders(tables: dict[str, str | list[dict]]) -> set[str]:
    """All that a manifest's tables lie in."""
    return {p if isinstance(p, str) else p["at"] for parts in tables.values() for p in ([parts] if isinstance(parts, str) else parts)}


def _bucket(by: tuple[str, ...], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int")


def last_by(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Of each key the row that comes last by `order`, a total order of its rows; picked before rows are moved."""
    best = F.max_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(F.col(key).alias("_key")).agg(best.alias("_row")).select("_row.*")


def replaced(old: DataFrame, new: DataFrame, key: str, *order: str) -> DataFrame:
    """old with the rows of new in place of those of the same key. Where new has a key more than once, the last by `order` holds; without an order new must have each key once."""
    new = last_by(new, key, *order) if order else new
    return old.join(new.select(key).distinct(), key, "left_anti").select(*new.columns).unionByName(new)


def replaced_chunks(old: DataFrame, new: DataFrame, written: DataFrame) -> DataFrame:
    """All chunks of the written documents (identifier) give way to the new ones, each chunk_id once, also where a document has none now."""
    gone = written.select(F.col("identifier").alias("parent_identifier")).distinct()
    return old.join(gone, "parent_identifier", "left_anti").select(*new.columns).unionByName(last_by(new, "chunk_id", "char_start", "char_end", "text"))


def payload(chunks: DataFrame) -> DataFrame:
    """point_id, embedding, payload: the metadata flat, then the contract's fields, which win."""
    flat = F.transform_values("metadata", lambda k, v: F.array_join(v.vals, "; "))
    contract = {"chunk_id": "chunk_id", "identifier": "parent_identifier", "document_type": "document_type", "nature": "nature", "char_start": "char_start", "char_end": "char_end"}
    fields = F.map_filter(F.create_map(*(x for k, c in contract.items() for x in (F.lit(k), F.col(c).cast("string")))), lambda k, v: v.isNotNull())
    merged = F.map_concat(F.map_filter(flat, lambda k, v: ~F.map_contains_key(fields, k)), fields)
    return chunks.select(T.point_id(F.col("chunk_id")).alias("point_id"), "embedding", merged.alias("payload"))


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    """Keys that a table has more than once; empty where the key is unique."""
    return df.groupBy(*key).count().where("count > 1")


def run_summary(spark: SparkSession, run_id: str, sources: list[str], status: str, counts: dict[str, int], started: datetime, error: str | None = None) -> DataFrame:
    row = (run_id, sources, status, started, datetime.now(UTC), counts, error)
    return spark.createDataFrame([row], "run_id string, sources array<string>, status string, started_at timestamp, ended_at timestamp, counts map<string,bigint>, error_message string")
