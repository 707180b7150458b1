"""URL filters on a sorted digest array.

A list of rules (host and path, as in `example.org/es/`) becomes files of up to `per_file` rules, each a range of
digests: the xxhash64 keys of the rules in order, the places of their strings, and the strings. Every executor gets the
files from the driver and memory-maps them, so a list takes room on its disk and not in its memory; a batch of urls is probed by
one vectorised binary search in each range, and a key that is found counts only if the stored string is the probed one.

A rule fits its host and all subdomains, if the url's path starts with the rule's path. The probes of
a url are the suffixes of its host and the prefixes of its path that have as many labels and bytes as some rule has. The
longest fitting rule decides, by its whole length, then by its host's; what no rule fits is allowed.

Null urls and urls without `://` have an empty host and path, and are allowed. Pages are judged row by row, so repeated rows,
ties and extra columns have no effect; an empty table gives no rows, an empty list allows all.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERDICTS = "page_id long, host string, path string, rule string, verdict string"


class DigestArray:
    """The rules of a file, mapped and not read. shapes: the numbers of labels and of bytes of a path that rules have together."""

    def __init__(self, path: str) -> None:
        head = np.fromfile(path, np.int64, 2)
        n, self.shapes = int(head[0]), [tuple(x) for x in np.fromfile(path, np.int64, 2 * int(head[1]), offset=16).reshape(-1, 2).tolist()]
        at = 16 + 16 * len(self.shapes)
        if not n:
            self.keys = np.empty(0, np.uint64)
            return
        self.keys = np.memmap(path, np.uint64, "r", at, (n,))
        self.places = np.memmap(path, np.int64, "r", at + 8 * n, (n + 1,))
        self.strings = np.memmap(path, np.uint8, "r", at + 8 * (2 * n + 1), (max(1, int(self.places[-1])),))

    @staticmethod
    def write(path: str, rules: Iterable[tuple[str, str, bool]], per_file: int | None = None) -> list[str]:
        """rules: (host, path, allow). Of equal ones the last holds. Returns the files: path, and path.1 and so on for further ranges of digests."""
        held = {(host + "/" + rest.removeprefix("/")): (host.count(".") + 1, len(("/" + rest.removeprefix("/")).encode()), allow) for host, rest, allow in rules}
        rows = sorted((xxhash.xxh64_intdigest(text.encode()), text.encode(), shape) for text, shape in held.items())
        step, files = per_file or max(1, len(rows)), []
        for at in range(0, max(1, len(rows)), step):
            part = rows[at : at + step]
            shapes = np.asarray(sorted({shape[:2] for *_, shape in part}), np.int64)
            blobs = [bytes([shape[2]]) + text for _, text, shape in part]
            places = np.r_[0, np.cumsum([len(b) for b in blobs])].astype(np.int64)
            files.append(f"{path}.{at // step}" if at else path)
            with open(files[-1], "wb") as f:
                np.asarray([len(part), len(shapes)], np.int64).tofile(f)
                shapes.tofile(f)
                if part:
                    np.asarray([k for k, *_ in part], np.uint64).tofile(f)
                    places.tofile(f)
                    f.write(b"".join(blobs) or b"\0")
        return files

    def lookup(self, texts: list[bytes]) -> list[bool | None]:
        """Of each text whether its rule allows; None if it is no rule."""
        out: list[bool | None] = [None] * len(texts)
        if not len(self.keys) or not texts:
            return out
        probes = np.fromiter(map(xxhash.xxh64_intdigest, texts), np.uint64, len(texts))
        at = np.searchsorted(self.keys, probes)
        hit = np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == probes))
        for i in hit.tolist():
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == probes[i]:
                stored = self.strings[self.places[j] : self.places[j + 1]].tobytes()
                if stored[1:] == texts[i]:
                    out[i] = bool(stored[0])
                    break
                j += 1
        return out


def probes(host: str, path: str, shapes: list[tuple[int, int]]) -> Iterator[tuple[bytes, bytes]]:
    """(host, path) of the rules that could fit, as UTF-8: a few for each of shapes, however long the url is."""
    if not host:
        return
    raw, suffixes = path.encode(), {}
    most = max((n for n, _ in shapes), default=0)
    tail = host.rsplit(".", most)  # the labels that count, and all before them in one
    for n, size in shapes:
        # A rule without a path is stored as `host/`; a url without one has an empty path, which no other rule begins.
        if size <= len(raw) and n <= len(tail):
            if n not in suffixes:
                suffixes[n] = ".".join(tail[-n:]).encode() if n < len(tail) or len(tail) <= most else None
            if suffixes[n] is not None:
                yield suffixes[n], raw[:size]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: from the first :// up to / ? # or the end, A-Z lower-cased; path: on to ? # or the end. Else both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "(?s)^[^/?#]*(/[^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


def publish(spark, rules: Iterable[tuple[str, str, bool]], per_file: int = 10_000_000) -> list[str]:
    """Give the files of the rules to all executors; returns their names. They lie in the folder that Spark keeps for such files, and go with it."""
    path = Path(SparkFiles.getRootDirectory()) / "rules" / f"rules-{uuid.uuid4().hex}.digests"
    path.parent.mkdir(exist_ok=True)
    files = DigestArray.write(str(path), rules, per_file)
    for f in files:
        spark.sparkContext.addFile(f)
    return [Path(f).name for f in files]


def _judge(names: list[str]):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = [DigestArray(SparkFiles.get(name)) for name in names]
        shapes = sorted({shape for held in ranges for shape in held.shapes})
        for batch in batches:
            owner, split, texts = [], [], []
            for k, (host, path) in enumerate(zip(batch["host"].to_pylist(), batch["path"].to_pylist(), strict=True)):
                for h, p in probes(host, path, shapes):
                    owner.append(k)
                    split.append(len(h))
                    texts.append(h + p)
            best: dict[int, tuple[int, int, bytes, bool]] = {}
            for held in ranges:
                for k, at, text, allow in zip(owner, split, texts, held.lookup(texts), strict=True):
                    if allow is not None and (len(text), at) > best.get(k, (-1, -1))[:2]:
                        best[k] = (len(text), at, text, allow)
            rule = [best[k][2].decode() if k in best else None for k in range(batch.num_rows)]
            verdict = ["allow" if k not in best or best[k][3] else "block" for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["host"], batch["path"], pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return judge


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, bool]], per_file: int = 10_000_000) -> DataFrame:
    """One row for each row of pages (page_id, url): page_id, host, path, rule, verdict."""
    name = publish(pages.sparkSession, rules, per_file)
    host, path = host_and_path(F.col("url"))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path")).mapInArrow(_judge(name), VERDICTS)
