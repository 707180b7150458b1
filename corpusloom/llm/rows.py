"""Rows told apart by where they stand in their files, whatever their columns hold."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import drop_table, write_table

FILE, AT = "_row_file", "_row_at"
#: Tasks that write a small table at most: so many, and one more for so many documents. Each shuffle partition would make a file otherwise, however few rows it has.
TASKS, TASK_ROWS = 16, 10_000


def writers(documents: int) -> int:
    return TASKS + documents // TASK_ROWS


def _one_to_one(plan) -> bool:
    """Whether each row of an analysed plan is one row of a file scan: projections and filters over it, and nothing that repeats or joins rows."""
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.child()
    return plan.getClass().getSimpleName() == "LogicalRelation"


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docs, the same with FILE and AT): hash of the file's path and place in it, equal in every scan.

    Rows that don't come one by one from files are written first, and the written table is what is returned: of rows made from one
    row of a file, as by explode, join or union, each has a place of its own there.
    """

    def of(df: DataFrame) -> DataFrame:
        return df.select("*", F.xxhash64("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(AT))

    if {FILE, AT} & set(docs.columns):
        raise ValueError(f"columns {FILE} and {AT} are this module's own")
    plan = docs._jdf.queryExecution().analyzed()
    if not _one_to_one(plan) or "_metadata" not in plan.metadataOutput().mkString(","):
        docs = write_table(docs, "rows")
    return docs, of(docs)


#: Rows of a file that one bitmap covers, and bits that a broadcast has at most: 32 MB.
BLOCK, BROADCAST_BITS = 1 << 15, 1 << 28


def _bitmaps(kept: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """(FILE, block) -> which of the block's rows are kept, from the first to the last that is."""

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf[AT].to_numpy() % BLOCK
        held = np.zeros(at.max() + 1, np.uint8)
        held[at] = 1
        return pd.DataFrame({FILE: pdf[FILE].iloc[:1], "block": pdf["block"].iloc[:1], "bits": [np.packbits(held).tobytes()]})

    rows = kept.select(FILE, AT, F.shiftright(AT, BLOCK.bit_length() - 1).alias("block"))
    made = rows.groupBy(FILE, "block").applyInPandas(packed, f"{FILE} long, block long, bits binary")
    return {(r[FILE], r["block"]): np.frombuffer(r["bits"], np.uint8) for r in made.toLocalIterator()}


def _is_kept(shared: Broadcast):
    """FILE, AT -> whether the row's bit is set in what _bitmaps() gave."""

    @F.pandas_udf("boolean")
    def is_kept(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for files, places in batches:
            file, at = files.to_numpy(), places.to_numpy()
            out, block = np.zeros(len(file), bool), at // BLOCK
            for f, b in set(zip(file.tolist(), block.tolist(), strict=True)):
                bits = shared.value.get((f, b))
                if bits is not None:
                    here = np.flatnonzero((file == f) & (block == b))
                    place = at[here] - b * BLOCK
                    here, place = here[place < 8 * len(bits)], place[place < 8 * len(bits)]
                    out[here] = bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1
            yield pd.Series(out)

    return is_kept


def only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of numbered docs whose FILE and AT are in kept, each once; without these columns.

    The rows themselves don't move: tasks get a bit for each row. Where that is more than BROADCAST_BITS in all, files are taken in groups, and
    a group's files are read with that group's bits alone, so a broadcast has its bound at every size.
    """
    spark = docs.sparkSession
    n = docs.count()
    kept = write_table(kept.select(FILE, AT), "rows-kept", tasks=writers(n))
    groups = 1 + n // BROADCAST_BITS
    parts = []
    for group in range(groups):
        mine = F.pmod(FILE, F.lit(groups)) == group
        shared = spark.sparkContext.broadcast(_bitmaps(kept.where(mine)))
        parts.append(docs.where(mine).where(_is_kept(shared)(FILE, AT)))
    drop_table(kept)
    return reduce(DataFrame.unionByName, parts).drop(FILE, AT)
