"""Answers to questions: exact cosine top-k over passages, their parents, the context for a prompt."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from corpusloom.functions import text as T

DOCUMENT_TYPES = ("article", "section", "texte", "decision")
NO_CONTEXT = "Aucun passage pertinent n'a été trouvé."


class ContractViolation(ValueError):
    """What a store returned does not have the agreed form."""


def last_question(messages: DataFrame, by: str = "conv_id") -> DataFrame:
    """by, question: the text of the last user message of each conversation. messages: by, turn, role, text."""
    users = messages.where("role = 'user'")
    return users.groupBy(by).agg(F.max_by("text", "turn").alias("question")).where(T.strip(F.col("question")) != "")


def joined_parts(parts: Column) -> Column:
    """The text parts of a message, concatenated. parts: array<struct<type, text>>."""
    return F.array_join(F.transform(F.filter(parts, lambda p: p.type == "text"), lambda p: p.text), "")


#: Bytes of questions' vectors that a task holds at once.
QUESTION_BYTES = 256 << 20
#: Places of a product of vectors that a task holds at once.
PRODUCT_CELLS = 1 << 20
#: By how much the cosine of a matrix product may differ from the one that is summed place by place.
SLACK = 1e-9


def _summed(a: np.ndarray) -> np.ndarray:
    """Sums of rows from left to right, so that equal vectors get equal scores wherever they stand."""
    return np.cumsum(a, axis=1)[:, -1] if a.shape[1] else np.zeros(len(a))


def _matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """Rows of a column of vectors; null ones are zero, others must have the width."""
    filled = np.zeros((len(vectors), width))
    held = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)[held]
    if (sizes != width).any():
        raise ContractViolation(f"vectors of {width} places were expected")
    filled[held] = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(held), width)
    return filled


class Held:
    """The best k scores of each of n questions in one task, rising."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.top = k, np.full((n, k), -np.inf)

    def keep(self, asked: slice, which: np.ndarray, order: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Of scored rows of a batch those that may be among the best k, by question, score and the order of their keys; no more than k for a question. which: places in the slice."""
        ranked = np.lexsort((order, -score, which))
        ranked = ranked[score[ranked] >= self.top[asked, 0][which[ranked]]]
        place = np.arange(len(ranked)) - np.searchsorted(which[ranked], which[ranked])
        ranked, place = ranked[place < self.k], place[place < self.k]
        new = np.full(self.top[asked].shape, -np.inf)
        new[which[ranked], place] = score[ranked]
        self.top[asked] = np.sort(np.concatenate([self.top[asked], new], axis=1), axis=1)[:, -self.k :]
        return ranked


def kth(scores: np.ndarray, k: int) -> np.ndarray | float:
    """The k-th best score of each column."""
    return np.partition(scores, len(scores) - k, axis=0)[len(scores) - k] if len(scores) > k else -np.inf


class _Best(Held):
    """What of a batch of vectors may be among the best k of a question."""

    def __init__(self, questions: np.ndarray, k: int, min_score: float) -> None:
        super().__init__(len(questions), k)
        self.q, self.least = questions, min_score
        self.norm = np.sqrt(_summed(questions * questions))

    def cosines(self, x: np.ndarray, size: np.ndarray, rows: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Exact scores of pairs of rows and questions."""
        out = np.zeros(len(rows))
        for at in range(0, len(rows), 1 << 14):
            i, j = rows[at : at + (1 << 14)], asked[at : at + (1 << 14)]
            scale = size[i] * self.norm[j]
            out[at : at + len(i)] = np.divide(_summed(x[i] * self.q[j]), scale, out=np.zeros(len(i)), where=scale > 0)
        return out

    def of(self, vectors: np.ndarray, keys: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, questions, scores) of a batch that no k others of this task beat.

        One matrix product scores the distinct vectors; only pairs whose product comes within SLACK of the k-th best so far, or of the k-th of the batch, are
        scored exactly. The product errs by less than SLACK, so no pair that belongs to the best is left out.
        """
        x, first = np.unique(vectors, axis=0, return_inverse=True)
        # Of rows with one vector, those of the smallest keys win.
        order = sorted(range(len(keys)), key=lambda i: (first[i], keys[i] is not None, keys[i]))
        group = first[order]
        place = np.arange(len(order)) - np.searchsorted(group, group)
        order, group = np.asarray(order)[place < self.k], group[place < self.k]
        begin = np.searchsorted(group, np.arange(len(x) + 1))

        size = np.sqrt(_summed(x * x))
        scale = size[:, None] * self.norm[None, :]
        near = np.divide(x @ self.q.T, scale, out=np.zeros_like(scale), where=scale > 0)
        held = np.sort(self.top, axis=1)[:, 0]
        kth = np.partition(near, len(near) - self.k, axis=0)[len(near) - self.k] if len(near) > self.k else np.full(len(self.q), -np.inf)
        row, asked = np.nonzero(near >= np.maximum(np.maximum(held, kth), self.least) - SLACK)
        score = self.cosines(x, size, row, asked)
        fine = (score >= self.least) & (score >= held[asked])
        row, asked, score = row[fine], asked[fine], score[fine]

        copies = begin[row + 1] - begin[row]
        pick = np.repeat(begin[row] - np.cumsum(copies) + copies, copies) + np.arange(copies.sum())
        rows, asked, score = order[pick], np.repeat(asked, copies), np.repeat(score, copies)
        ranked = np.lexsort((np.arange(len(rows)), -score, asked))
        rows, asked, score = rows[ranked], asked[ranked], score[ranked]
        at = np.arange(len(rows)) - np.searchsorted(asked, asked)
        keep = at < self.k
        # Ties at the end of the k: their keys decide, which only the last step compares over tasks, so all of them go on, k of each vector at most.
        if len(rows):
            last = np.full(len(self.q), -np.inf)
            np.minimum.at(lowest := np.full(len(self.q), np.inf), asked[keep], score[keep])
            last[np.unique(asked)] = lowest[np.unique(asked)]
            new = np.full((len(self.q), self.k), -np.inf)
            new[asked[keep], at[keep]] = score[keep]
            self.top = np.sort(np.concatenate([self.top, new], axis=1), axis=1)[:, -self.k :]
            keep = score >= last[asked]
        return rows[keep], asked[keep], score[keep]

    def documents(self, held: _Passages, asked: slice, passages: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(documents, questions, scores; ends, rows and scores of their best passages) of a batch, for a slice of the questions; no k others of this task beat these documents.

        As in of(), a product of the distinct vectors tells which documents may be among the best; only their passages are scored exactly, equal ones once.
        """
        unit = np.divide(self.q[asked], self.norm[asked, None], out=np.zeros_like(self.q[asked]), where=self.norm[asked, None] > 0)
        near = np.maximum.reduceat((held.unit @ unit.T)[held.first], held.begin[:-1], axis=0)
        least = np.maximum(np.maximum(self.top[asked, 0], self.least), kth(near, self.k))
        which, doc = np.nonzero((near >= least - SLACK).T)
        count = held.begin[doc + 1] - held.begin[doc]
        starts = np.cumsum(count) - count
        rows = np.repeat(held.begin[doc] - starts, count) + np.arange(count.sum())
        pairs, at = np.unique(held.first[rows] * len(unit) + np.repeat(which, count), return_inverse=True)
        scores = self.cosines(held.x, held.norm, pairs // len(unit), pairs % len(unit) + asked.start)[at]
        score = np.maximum.reduceat(scores, starts) if len(starts) else scores
        fine = np.flatnonzero(score >= self.least)
        ranked = fine[self.keep(asked, which[fine], held.documents[doc[fine]], score[fine])]

        # The passages of each document that goes on, the best first.
        of = np.full(len(doc), -1)
        of[ranked] = np.arange(len(ranked))
        of = np.repeat(of, count)
        some = np.flatnonzero(of >= 0)
        some = some[np.lexsort((held.passages[rows[some]], -scores[some], of[some]))]
        some = some[np.arange(len(some)) - np.searchsorted(of[some], of[some]) < passages]
        ends = np.searchsorted(of[some], np.arange(len(ranked) + 1))
        return doc[ranked], which[ranked] + asked.start, score[ranked], ends, rows[some], scores[some]


def places(keys: pa.Array) -> np.ndarray:
    """The place of each key in their order, nulls first."""
    order = pc.sort_indices(keys, null_placement="at_start").to_numpy()
    places = np.empty(len(order), np.int64)
    places[order] = np.arange(len(order))
    return places


class _Passages:
    """The passages of a batch of documents: distinct vectors x, and for each passage which of them it has; places of passages and documents in the order of their keys."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, passages: np.ndarray, documents: np.ndarray) -> None:
        self.x, self.first = np.unique(vectors, axis=0, return_inverse=True)
        self.norm = np.sqrt(_summed(self.x * self.x))
        self.unit = np.divide(self.x, self.norm[:, None], out=np.zeros_like(self.x), where=self.norm[:, None] > 0)
        self.begin = np.r_[0, np.cumsum(sizes)].astype(np.int64)
        self.passages, self.documents = passages, documents


def top_k(chunks: DataFrame, queries: DataFrame, k: int = 5, min_score: float = 0.5, vector: str = "embedding", key: str = "chunk_id") -> DataFrame:
    """query_id, rank, score and the columns of chunks: exact cosine, ties by key; null vectors count as zero.

    queries (query_id, vector) are a stated set of questions; they go to the tasks as one matrix, QUESTION_BYTES at a time, so the chunks are read once for
    all of them, or once for each so many. A task keeps k rows of each question before the shuffle.
    """
    spark = chunks.sparkSession
    asked = queries.select("query_id", F.col("vector").alias("_q")).where("_q IS NOT NULL").toArrow()
    matrix = np.asarray(asked["_q"].to_pylist(), np.float64).reshape(len(asked), -1)
    schema = StructType([*chunks.schema.fields, *queries.select("query_id").schema.fields, StructField("score", DoubleType())])
    step = max(1, QUESTION_BYTES // max(8, matrix.shape[1] * 8))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    found = []
    for at in range(0, max(1, len(asked)), step):
        part = spark.sparkContext.broadcast((matrix[at : at + step], asked["query_id"].slice(at, step).combine_chunks()))

        def search(batches: Iterator[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
            questions, ids = part.value
            best = _Best(questions, k, min_score)
            for batch in batches:
                if not batch.num_rows or not len(questions):
                    continue
                rows, which, score = best.of(_matrix(batch[vector], questions.shape[1]), batch[key].to_pylist())
                if len(rows):
                    taken = batch.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([*taken.columns, ids.take(pa.array(which)), pa.array(score)], [*batch.schema.names, "query_id", "score"])

        found.append(chunks.mapInArrow(search, schema))
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(w))
    # A filter rank <= k lets Spark keep k rows a group before the exchange.
    return ranked.where(F.col("rank") <= k)


def nested_index(documents: DataFrame, chunks: DataFrame, *more: str) -> DataFrame:
    """One row for each document (identifier, ...) with passages array<struct<ordinal, chunk_id, embedding, more>> in their order; documents without a passage have an empty one.

    chunks: parent_identifier, ordinal, chunk_id, embedding, more. A document's passages are as many as its length allows.
    """
    fields = F.struct("ordinal", "chunk_id", "embedding", *more)
    nested = chunks.groupBy(F.col("parent_identifier").alias("identifier")).agg(F.sort_array(F.collect_list(fields)).alias("passages"))
    kind = nested.schema["passages"].dataType
    return documents.join(nested, "identifier", "left").withColumn("passages", F.coalesce("passages", F.array().cast(kind)))


def nested_hits(index: DataFrame, queries: DataFrame, documents: int = 100, passages: int = 3, min_score: float = -1.0) -> DataFrame:
    """query_id, rank, score (of its best passage), the index's columns but the passages, and hits array<struct<chunk_id, score>>: the best documents of each question with their best passages.

    A document carries its passages, so these are scored where they lie and come back without a join. queries: query_id, vector, a stated set, as in top_k(). Ties go
    by identifier and by chunk_id; null vectors count as zero; documents without a passage are not found. A batch meets so many questions at once that their products have
    PRODUCT_CELLS places, and of a batch no more than `documents` rows go on for a question.
    """
    spark = index.sparkSession
    asked = queries.select("query_id", "vector").where("vector IS NOT NULL").toArrow()
    matrix = np.asarray(asked["vector"].to_pylist(), np.float64).reshape(len(asked), -1)
    hit = ArrayType(StructType([StructField("chunk_id", index.schema["passages"].dataType.elementType["chunk_id"].dataType), StructField("score", DoubleType())]))
    rest = [f for f in index.schema.fields if f.name != "passages"]
    schema = StructType([*rest, *queries.select("query_id").schema.fields, StructField("score", DoubleType()), StructField("hits", hit)])
    step = max(1, QUESTION_BYTES // (8 * (2 * matrix.shape[1] + documents)))
    found = []
    for at in range(0, max(1, len(asked)), step):
        part = spark.sparkContext.broadcast((matrix[at : at + step], asked["query_id"].slice(at, step).combine_chunks()))

        def search(batches: Iterator[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
            questions, ids = part.value
            best = _Best(questions, documents, min_score)
            for batch in batches:
                column = batch["passages"]
                sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                if not sizes.sum() or not len(questions):
                    continue
                flat, full = column.flatten(), np.flatnonzero(sizes)
                held = _Passages(_matrix(flat.field("embedding"), questions.shape[1]), sizes[full], places(flat.field("chunk_id")), places(batch["identifier"])[full])
                rest_of, chunk_ids = batch.select([f.name for f in rest]), flat.field("chunk_id")
                kind = pa.struct([("chunk_id", chunk_ids.type), ("score", pa.float64())])
                step = max(1, PRODUCT_CELLS // len(held.first))
                for begin in range(0, len(questions), step):
                    doc, which, score, ends, rows, scores = best.documents(held, slice(begin, begin + step), passages)
                    if len(doc):
                        taken = rest_of.take(pa.array(full[doc]))
                        hits = pa.StructArray.from_arrays([chunk_ids.take(pa.array(rows)), pa.array(scores)], fields=list(kind))
                        hits = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), hits)
                        yield pa.RecordBatch.from_arrays([*taken.columns, ids.take(pa.array(which)), pa.array(score), hits], [*taken.schema.names, "query_id", "score", "hits"])

        found.append(index.mapInArrow(search, schema))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "identifier")
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= documents)


def valid_point() -> Column:
    """Whether a found passage has all that the contract asks for."""
    filled = (F.coalesce("chunk_id", F.lit("")) != "") & (F.coalesce("identifier", F.lit("")) != "")
    return filled & F.col("char_start").isNotNull() & F.col("char_end").isNotNull() & F.coalesce(F.col("document_type").isin(*DOCUMENT_TYPES), F.lit(False))


def checked(points: DataFrame) -> DataFrame:
    """points, or an error when the query runs if any of them breaks the contract."""
    return points.where(F.when(valid_point(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("contract violation: "), F.coalesce("chunk_id", F.lit("null")))).cast("boolean")))


def parents(documents: DataFrame, found: DataFrame) -> DataFrame:
    """identifier, title, content of the found passages' documents."""
    return documents.join(found.select("identifier").distinct(), "identifier", "left_semi").select("identifier", "title", "content")


def passages(found: DataFrame, documents: DataFrame, strict: bool = True) -> DataFrame:
    """found (rank, identifier, char_start, char_end, ...) with title, text and highlight bounds in UTF-16. A missing parent or a bad range is an error.

    Without `strict`, what has no parent is left out, and a range may pass its content's end: the text is what there is, and a missing code point counts as one unit.
    """
    held = found.join(parents(documents, found), "identifier", "left" if strict else "inner")
    content = F.col("content")
    if not strict:
        content = F.when(F.coalesce(F.char_length(content), F.lit(0)) >= F.col("char_end"), content).otherwise(F.rpad(F.coalesce(content, F.lit("")), F.col("char_end"), F.lit(" ")))
    bounds = T.utf16_range(content, F.col("char_start"), F.col("char_end"))
    wrong = F.raise_error(F.concat(F.lit("contract violation: "), F.col("identifier"))).cast("struct<start:int,end:int>")
    held = held.withColumn("highlight", F.coalesce(bounds, wrong))
    return held.withColumn("text", F.substring(F.col("content"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start")))


def source_parts(cut: DataFrame) -> DataFrame:
    """rank, kind ('parentDocument' or 'document'), identifier: in rank order, a parent once, before its first passage."""
    first = cut.groupBy("identifier").agg(F.min("rank").alias("rank")).select("rank", F.lit(0).alias("step"), F.lit("parentDocument").alias("kind"), "identifier")
    both = first.unionByName(cut.select("rank", F.lit(1).alias("step"), F.lit("document").alias("kind"), "identifier"))
    return both.orderBy("rank", "step").drop("step")


def context_text(cut: DataFrame, *by: str) -> DataFrame:
    """context: '[n] title' and text of each passage in rank order; one row for each question (`by`), else one for the few passages of a single answer, or a fixed sentence."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "title", "text"))), lambda p: F.concat(F.lit("["), p.rank.cast("string"), F.lit("] "), p.title, F.lit("\n"), p.text))
    return cut.groupBy(*by).agg(F.when(F.count("*") > 0, F.array_join(lines, "\n\n")).otherwise(F.lit(NO_CONTEXT)).alias("context"))


def prompt(system: str, context: Column, question: Column) -> Column:
    return F.to_json(F.array(F.struct(F.lit("system").alias("role"), F.concat(F.lit(system + "\n\n"), context).alias("content")), F.struct(F.lit("user").alias("role"), question.alias("content"))))


def stream_text(lines: DataFrame) -> DataFrame:
    """Text of a model's streamed answer: id, text. lines: id, n, line (complete ones; data: prefixes are allowed, [DONE] ends, other text is skipped)."""
    body = F.regexp_replace(T.strip(F.col("line")), "^data:\\s*", "")
    piece = F.get_json_object(body, "$.choices[0].delta.content")
    done = F.min(F.when(body == "[DONE]", F.col("n")))
    marked = lines.select("id", "n", piece.alias("piece"), body.alias("body"))
    ends = lines.groupBy("id").agg(done.alias("end"))
    kept = marked.join(ends, "id").where(F.col("piece").isNotNull() & (F.col("end").isNull() | (F.col("n") < F.col("end"))))
    return kept.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "piece"))), lambda x: x.piece), "").alias("text"))


def answer_parts(sources: DataFrame, deltas: DataFrame) -> DataFrame:
    """n, part: start, text-start, the sources, the deltas, text-end, finish. sources: rank, kind; deltas: n, text."""
    spark = sources.sparkSession
    frame = spark.createDataFrame([(0, 0, "start"), (1, 0, "text-start"), (4, 0, "text-end"), (5, 0, "finish")], "stage int, at int, part string")
    first = sources.select(F.lit(2).alias("stage"), (2 * F.col("rank") + (F.col("kind") == "document").cast("int")).cast("int").alias("at"), F.concat(F.lit("data-"), "kind").alias("part"))
    text = deltas.select(F.lit(3).alias("stage"), F.col("n").cast("int").alias("at"), F.lit("text-delta").alias("part"))
    return frame.unionByName(first).unionByName(text).orderBy("stage", "at").select("part")


def health(up: int, probes: int = 3) -> str:
    down = probes - up
    return "ok" if down == 0 else "degraded" if down == 1 else "down"


def ranking(scored: DataFrame, score: str, depth: int = 100, key: str = "chunk_id") -> DataFrame:
    """The best `depth` rows with their rank, ties by key; the limit comes first, so only depth rows meet in one task."""
    best = scored.orderBy(F.desc(score), key).limit(depth)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)))


def fuse_ranks(lexical: DataFrame, vector: DataFrame, constant: int = 60, by: tuple[str, ...] = ()) -> DataFrame:
    """by, chunk_id, score: reciprocal rank fusion of two rankings (by, chunk_id, rank)."""
    both = lexical.select(*by, "chunk_id", "rank").unionAll(vector.select(*by, "chunk_id", "rank"))
    return both.groupBy(*by, "chunk_id").agg(F.sum(1 / (constant + F.col("rank"))).alias("score"))


def passages_per_document(ranked: DataFrame, documents: int = 100, passages: int = 3) -> DataFrame:
    """Of a ranking (identifier, chunk_id, score) each chunk once, the best passages of the best documents."""
    once = ranked.groupBy("identifier", "chunk_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("identifier").orderBy(F.desc("score"), "chunk_id")
    few = once.withColumn("place", F.row_number().over(w)).where(F.col("place") <= passages)
    best = few.where("place = 1").orderBy(F.desc("score"), "identifier").limit(documents).select("identifier")
    return few.join(F.broadcast(best), "identifier", "left_semi")


def page(ranked: DataFrame, start: int, size: int, depth: int) -> DataFrame:
    """Rows start to start + size of the best `depth`. ranked: score, chunk_id, ..."""
    return ranked.orderBy(F.desc("score"), "chunk_id").limit(depth).offset(start).limit(size)
