"""Passages: windows over a document's blocks, addressed by code points of its content."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T


@dataclass(frozen=True)
class ChunkConfig:
    max_chars: int
    overlap_chars: int

    def __post_init__(self) -> None:
        for value in (self.max_chars, self.overlap_chars):
            if isinstance(value, bool) or not isinstance(value, int):
                raise TypeError("sizes are whole numbers")
        if self.max_chars <= 0 or not 0 <= self.overlap_chars < self.max_chars:
            raise ValueError("max_chars must be positive and overlap_chars from 0 to less than it")


def _bound(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def windows(length: Column, config: ChunkConfig) -> Column:
    """array<struct<start, end>>: windows of max_chars that overlap, up to the first that reaches the end."""
    size, step = config.max_chars, config.max_chars - config.overlap_chars
    last = F.greatest(F.ceil((length - size) / step), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * step).alias("start"), F.least(i * step + size, length).cast("int").alias("end")))


def text_windows(text: Column, config: ChunkConfig) -> Column:
    """array<struct<start, end, text>>: the windows of a text.

    One pass cuts the text into pieces of a step; a window is some of these and the front of the next, so work grows with the text.
    """
    size, step = config.max_chars, config.max_chars - config.overlap_chars
    whole, rest = divmod(size, step)

    def of(held: Column) -> Column:
        def window(w: Column) -> Column:
            i = (w.start / step).cast("int")
            front = F.array_join(F.slice(held.pieces, i + 1, whole), "")
            more = F.substring(F.coalesce(F.try_element_at(held.pieces, i + 1 + whole), F.lit("")), F.lit(1), F.lit(rest))
            return F.struct(w.start.alias("start"), w.end.alias("end"), F.concat(front, more).alias("text"))

        return F.transform(windows(held.n, config), window)

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    return _bound(F.struct(F.char_length(text).alias("n"), pieces.alias("pieces")), of)


def blocks(content: Column, sections: Column) -> Column:
    """array<struct<path, text, at>>: each non-blank section where the content has it after the one before; what is not found is left out. No block: the whole content."""
    empty = F.array().cast("array<struct<path:array<string>,text:string,at:int>>")
    start = F.struct(F.lit(1).alias("cursor"), empty.alias("found"))

    def step(held: Column, s: Column) -> Column:
        at = F.position(s.text, content, held.cursor)
        fine = (T.strip(s.text) != "") & (at > 0)
        entry = F.struct(s.path.alias("path"), s.text.alias("text"), (at - 1).cast("int").alias("at"))
        return F.when(fine, F.struct((at + F.char_length(s.text)).cast("int").alias("cursor"), F.concat(held.found, F.array(entry)).alias("found"))).otherwise(held)

    found = F.aggregate(sections, start, step, lambda held: held.found)
    whole = F.array(F.struct(F.array().cast("array<string>").alias("path"), content.alias("text"), F.lit(0).alias("at")))
    return _bound(found, lambda held: F.when(F.size(held) > 0, held).otherwise(whole))


def chunk(docs: DataFrame, config: ChunkConfig) -> DataFrame:
    """Columns of docs: identifier, document_type, nature, content, sections, metadata. Blank contents give no chunk."""
    spans = F.flatten(F.transform(F.col("blocks"), lambda b: F.transform(text_windows(b.text, config), lambda w: F.struct(b.path.alias("tag_path"), w.text.alias("text"), (b.at + w.start).alias("char_start"), (b.at + w.end).alias("char_end")))))
    kept = docs.where(T.strip(F.col("content")) != "").withColumn("blocks", blocks(F.col("content"), F.col("sections")))
    out = kept.select("identifier", "document_type", "nature", "metadata", F.posexplode(spans).alias("ordinal", "span"))
    return out.select(T.chunk_id(F.col("identifier"), F.col("ordinal")).alias("chunk_id"), F.col("identifier").alias("parent_identifier"), "document_type", "nature", "ordinal", "span.text", "span.tag_path", "span.char_start", "span.char_end", "metadata")
