"""Packing token sequences: concatenate and cut.

First pass: every task numbers its documents' tokens from 0 and writes them with its own number.
The totals of the tasks, summed in order, give each task's place in the concatenation. Second pass:
fixed windows of that axis are the sequences; a document that crosses a window's edge leaves one
record on either side. Only the last sequence is padded.

Every row is packed, repeated ones too; null and empty texts have the end token alone. An empty
table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.bpe import encode_documents
from corpusloom.session import write_table

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long"


def _number(end_id: int):
    """Ends each document and numbers the tokens of a task: at is the place of a document's first one."""
    end = np.asarray([end_id], "<u4").tobytes()
    held = {"task": None, "at": 0}

    def number(batch: pa.RecordBatch) -> pa.RecordBatch:
        task = TaskContext.get()
        if held["task"] != task.taskAttemptId():
            held.update(task=task.taskAttemptId(), at=0)
        ids = pc.binary_join_element_wise(batch["ids"], end, b"")
        n = pc.binary_length(ids).to_numpy().astype(np.int64) // 4
        starts = held["at"] + np.cumsum(n) - n
        held["at"] += int(n.sum())
        part = np.full(len(n), task.partitionId(), np.int32)
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(part), pa.array(starts), pa.array(n), ids], ["doc_id", "part", "at", "n", "ids"])

    return number


PLACED = "doc_id long, part int, at long, n long, ids binary"


def place(held: DataFrame) -> DataFrame:
    """doc_id, at (place of its first token on the common axis), n, ids; held: a written table of PLACED."""
    totals = held.groupBy("part").agg(F.sum("n").alias("total"))
    # One row for each task of the first pass, so the window and the broadcast stay small at any input size.
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    return held.join(F.broadcast(offsets), "part").select("doc_id", (F.col("at") + F.col("base")).alias("at"), "n", "ids")


def pack(held: DataFrame, length: int) -> DataFrame:
    """held: a written table of PLACED. One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = batch["at"].to_numpy(), batch["n"].to_numpy()
            first, last = at // length, (at + n - 1) // length
            count = last - first + 1
            row = np.repeat(np.arange(len(n)), count)
            window = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + first[row]
            begin = np.maximum(window * length, at[row])
            stop = np.minimum((window + 1) * length, at[row] + n[row])
            ids = [memoryview(x.as_buffer()) for x in batch["ids"]]
            crc = [zlib.crc32(ids[r][4 * b : 4 * e]) for r, b, e in zip(row.tolist(), (begin - at[row]).tolist(), (stop - at[row]).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(pa.array(row)), pa.array(begin - at[row]), pa.array(stop - begin), pa.array(crc, pa.int64()), pa.array(n[row]), pa.array(window), pa.array(begin - window * length)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return place(held).mapInArrow(cut, PIECES)


def pack_documents(docs: DataFrame, path: str, length: int = 2048, end_id: int = 1) -> DataFrame:
    """Tokenize docs (doc_id, text) with the tokenizers file at `path`, without trees, and pack them."""
    held = write_table(encode_documents(docs, path, then=_number(end_id), schema=PLACED, whole=True), "packing-ids")
    return pack(held, length)
