"""Lexical search: two analysers, an inverted index in blocks, exact BM25 top-k that skips blocks, and the same over a whole table without an index.

Natural language goes to terms by splitting words, elision, lower case, folding of accents, stop words and a light French
stemmer; legal references (articles, appeals, laws, ECLI) go to terms of their own, in a compact form. Both
analyse passages and questions alike. Spark cuts a text into words; of a batch each distinct word goes to its term once.

The index holds for each term and passage what BM25 gives it, in whole millionths, so that sums don't depend on their order. Passages
are dealt over blocks by a hash, and so are the postings of a frequent term. Each term's greatest weight in a block bounds what a passage there can get: a
question scores its most promising block first, and then only those whose bound reaches the k-th score found.

An index serves questions that come later. For a stated set of questions to all passages, search() needs none: one scan counts the terms that are asked
for, and a second, over these counts alone, gives each question its best passages of each task.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corpusloom.operators import retrieval
from corpusloom.session import write_table

WORD = "[\\p{L}\\p{N}]+(?:['’][\\p{L}\\p{N}]+)*"
ELISION = "^(?:l|m|t|n|s|j|d|c|qu|jusqu|lorsqu|puisqu|quoiqu)['’]"
ACCENTED, PLAIN = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
#: French function words, folded.
STOP_WORDS = (
    "a", "ai", "au", "aux", "avec", "ce", "ces", "cet", "cette", "comme", "dans", "de", "des", "donc", "du", "elle", "elles", "en", "est", "et", "eux", "il", "ils", "je", "la", "le", "les", "leur", "leurs", "lui",
    "ma", "mais", "me", "meme", "mes", "moi", "mon", "ne", "ni", "nos", "notre", "nous", "on", "ont", "ou", "par", "pas", "pour", "qu", "que", "qui", "sa", "se", "ses", "soit", "son", "sont", "sur", "ta", "te", "tes",
    "toi", "ton", "tu", "un", "une", "vos", "votre", "vous", "y",
)
#: Article numbers, numbers of appeals, of laws, and European case identifiers.
REFERENCE = "(?i)\\b(?:[LRDA]\\.? ?\\*?[0-9]+(?:-[0-9]+)*|[0-9]{2}-[0-9]{2}\\.[0-9]{3}|[0-9]{4}-[0-9]{2,}|ECLI:[A-Z]{2}:[A-Z]+:[0-9]{4}:[A-Z0-9.]+)"
REF = "ref:"
K1, B = 1.2, 0.75
#: Passages in a block, about.
BLOCK = 4096


#: Words that a task holds with their terms.
HELD_WORDS = 1 << 18
#: Scores of passages and questions that a task holds at once.
SCORE_CELLS = 1 << 20

_ELISION = re.compile(ELISION)
_FOLDED = {**str.maketrans(ACCENTED, PLAIN), ord("œ"): "oe"}
_STOPPED = frozenset(STOP_WORDS)


def stem(word: str) -> str:
    """Minimal French stemming of a folded word: plurals in -aux and -x, then s, r and e at the end, then a doubled last letter. Words of under six letters stay."""
    if len(word) < 6:
        return word
    if word.endswith("x"):
        return word[:-2] + "l" if word.endswith("aux") else word[:-1]
    bare = word.removesuffix("s").removesuffix("r").removesuffix("e").removesuffix("e")
    return bare[:-1] if bare[-1:] == bare[-2:-1] else bare


def french_term(word: str) -> str:
    """The term of a lower-case word; '' for stop words. Terms of references pass."""
    if word.startswith(REF):
        return word
    if not word.isalnum():  # only apostrophes are none
        word = _ELISION.sub("", word)
    folded = word if word.isascii() else word.translate(_FOLDED)
    return "" if folded in _STOPPED else stem(folded)


def reference_term(found: Column) -> Column:
    """`L. 1234-5` and `l1234-5` give ref:l1234-5; other references are lower-cased."""
    return F.concat(F.lit(REF), F.when(found.rlike("(?i)^[LRDA][. *0-9]"), F.translate(F.lower(found), ". *", "")).otherwise(F.lower(found)))


def _cut(texts: DataFrame, key: str, references: bool = True) -> DataFrame:
    """key, words: lower-case words and, if asked for, the terms of references."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))
    found = F.transform(F.regexp_extract_all("text", F.lit(REFERENCE), F.lit(0)), reference_term)
    return texts.select(key, (F.concat(words, found) if references else words).alias("words"))


def _occurrences(words: pa.ListArray, held: dict[str, str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(rows, places of their terms, terms) of all words that have a term. held: terms of words met before."""
    sizes = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    coded = words.flatten().dictionary_encode()
    found = []
    for word in coded.dictionary.to_numpy(zero_copy_only=False).tolist():
        term = held.get(word)
        if term is None:
            held[word] = term = french_term(word)
        found.append(term or None)
    if len(held) > HELD_WORDS:
        held.clear()
    terms_of = pa.array(found, pa.string()).dictionary_encode()
    place = terms_of.indices.fill_null(-1).to_numpy(zero_copy_only=False)[coded.indices.to_numpy(zero_copy_only=False)]
    row = np.repeat(np.arange(len(words)), sizes)
    return row[place >= 0], place[place >= 0].astype(np.int64), terms_of.dictionary


def terms(texts: DataFrame, key: str) -> DataFrame:
    """key, term, tf. texts: key, text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, str] = {}
        for batch in batches:
            row, place, found = _occurrences(batch["words"], held)
            pairs, n = np.unique(row * max(1, len(found)) + place, return_counts=True)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([batch[key].take(pa.array(pairs // len(found))), found.take(pa.array(pairs % len(found))), pa.array(n, pa.int64())], [key, "term", "tf"])

    schema = StructType([*texts.select(key).schema.fields, *StructType.fromDDL("term string, tf long").fields])
    return _cut(texts, key).mapInArrow(count, schema).groupBy(key, "term").agg(F.sum("tf").alias("tf"))


def build_index(passages: DataFrame, key: str = "chunk_id", block_size: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(term, block, key, weight; term, block, top: the greatest weight), written tables. passages: key (unique), text.

    Lengths are those of a field, words or references, and so are the means.
    """
    n = passages.count()
    blocks = max(1, -(-n // block_size))
    is_ref = F.col("term").startswith(REF)
    counted = terms(passages, key).withColumn("_ref", is_ref)
    counted = counted.withColumn("_length", F.sum("tf").over(Window.partitionBy(key, "_ref"))).withColumn("block", F.pmod(F.xxhash64(key), F.lit(blocks)))
    counted = write_table(counted, "lexical-terms")
    total = {r["_ref"]: r["n"] for r in counted.groupBy("_ref").agg(F.sum("tf").alias("n")).collect()}
    mean = F.when(is_ref, F.lit(total.get(True, 0) / max(n, 1))).otherwise(F.lit(total.get(False, 0) / max(n, 1)))
    # A frequent term meets its number of passages block by block, so its postings are not one task's.
    held = counted.groupBy("term", "block").agg(F.count(F.lit(1)).alias("_n"))
    held = held.select("term", "block", F.sum("_n").over(Window.partitionBy("term")).alias("_df"))
    idf = F.log(1 + (F.lit(float(n)) - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    weight = idf * F.col("tf") / (F.col("tf") + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("_length") / mean))
    weights = write_table(counted.join(held, ["term", "block"]).select("term", "block", key, F.round(weight * 1_000_000).cast("long").alias("weight")), "lexical-weights")
    return weights, write_table(weights.groupBy("term", "block").agg(F.max("weight").alias("top")), "lexical-tops")


def top_k(index: tuple[DataFrame, DataFrame], questions: DataFrame, k: int = 10, key: str = "chunk_id") -> DataFrame:
    """query_id, key, score (millionths), rank; ties by key. questions: query_id, text, a stated set. Passages without a term of the question are not found."""
    weights, tops = index
    asked = write_table(terms(questions.select("query_id", "text"), "query_id").select("query_id", "term"), "lexical-asked")
    bounds = write_table(asked.join(tops, "term").groupBy("query_id", "block").agg(F.sum("top").alias("bound")), "lexical-bounds")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), key)

    def scored(where: DataFrame) -> DataFrame:
        found = where.select("query_id", "block").join(asked, "query_id").join(weights, ["term", "block"])
        ranked = found.groupBy("query_id", key).agg(F.sum("weight").alias("score")).withColumn("rank", F.row_number().over(best))
        return ranked.where(F.col("rank") <= k)

    first = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    promising = bounds.withColumn("_k", F.row_number().over(first)).where("_k = 1")
    reached = scored(promising).groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("_least"))
    return scored(bounds.join(reached, "query_id").where("_least IS NULL OR bound >= _least"))


def _asked_counts(passages: DataFrame, key: str, asked: pa.Array) -> DataFrame:
    """key, lengths of its two fields (words and references), ids of the asked terms that it has, their counts."""
    spark = passages.sparkSession
    names = spark.sparkContext.broadcast(asked)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, str] = {}
        for batch in batches:
            row, place, found = _occurrences(batch["words"], held)
            is_ref = pc.starts_with(found, REF).to_numpy(zero_copy_only=False)[place] if len(found) else np.zeros(0, bool)
            lengths = [np.bincount(row[is_ref == ref], minlength=batch.num_rows) for ref in (False, True)]
            ids = pc.index_in(found, value_set=names.value).fill_null(-1).to_numpy(zero_copy_only=False)[place] if len(found) else place
            pairs, n = np.unique(row[ids >= 0] * len(names.value) + ids[ids >= 0], return_counts=True)
            ends = pa.array(np.searchsorted(pairs // len(names.value), np.arange(batch.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (pairs % len(names.value), n)]
            yield pa.RecordBatch.from_arrays([batch[key], *(pa.array(x, pa.int64()) for x in lengths), *lists], [key, "words", "refs", "ids", "counts"])

    schema = StructType([*passages.select(key).schema.fields, *StructType.fromDDL("words long, refs long, ids array<int>, counts array<int>").fields])
    references = bool(pc.any(pc.starts_with(asked, REF)).as_py())
    counted = write_table(_cut(passages, key, references).mapInArrow(count, schema), "lexical-counts")
    # Rows of one key, which are rare, are one passage.
    repeated = counted.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key)
    if repeated.isEmpty():
        return counted
    same = F.col(key).eqNullSafe(F.col("_key"))
    repeated = write_table(repeated.withColumnRenamed(key, "_key"), "lexical-repeated")
    merged = counted.join(repeated, same, "left_semi").groupBy(key).agg(F.sum("words").alias("words"), F.sum("refs").alias("refs"), F.flatten(F.collect_list("ids")).alias("ids"), F.flatten(F.collect_list("counts")).alias("counts"))
    return write_table(counted.join(repeated, same, "left_anti").unionByName(merged), "lexical-counts")


def search(passages: DataFrame, questions: DataFrame, k: int = 10, key: str = "chunk_id") -> DataFrame:
    """query_id, key, score (millionths), rank, as top_k() gives them over an index of all passages, whose statistics hold here, too. passages: key, text; questions: query_id, text, a stated set.

    The questions' terms go to the tasks, which count them in each passage; of the rest only a passage's length is needed. The scores of a batch of passages are sums over their
    counts, SCORE_CELLS at a time, and no more than k rows of it go on for a question. Passages without a key count, and are not found.
    """
    spark = passages.sparkSession
    asked = terms(questions.select("query_id", "text"), "query_id").select("query_id", "term").toArrow().combine_chunks()
    schema = StructType([*questions.select("query_id").schema.fields, *passages.select(key).schema.fields, StructField("score", LongType())])
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    if not asked.num_rows:
        return spark.createDataFrame([], schema).withColumn("rank", F.row_number().over(best))
    names, who = asked["term"].unique(), asked["query_id"].unique()
    term_of, who_of = (pc.index_in(asked[c], value_set=v).to_numpy() for c, v in (("term", names), ("query_id", who)))
    order = np.argsort(term_of, kind="stable")
    begin, askers = np.searchsorted(term_of[order], np.arange(len(names) + 1)), who_of[order].astype(np.int64)

    n = passages.count()
    counted = _asked_counts(passages.select(key, "text"), key, names)
    total = counted.agg(F.sum("words"), F.sum("refs")).first()
    held_by = dict(counted.select(F.explode(F.array_distinct("ids")).alias("id")).groupBy("id").count().collect())
    idf = np.array([math.log(1 + (n - df + 0.5) / (df + 0.5)) for df in (held_by.get(i, 0) for i in range(len(names)))])
    is_ref = pc.starts_with(names, REF).to_numpy(zero_copy_only=False)
    mean = np.where(is_ref, (total[1] or 0) / max(n, 1), (total[0] or 0) / max(n, 1))
    part = spark.sparkContext.broadcast((begin, askers, idf, is_ref, mean, who))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, askers, idf, is_ref, mean, who = part.value
        best, everyone = retrieval.Held(len(who), k), slice(0, len(who))
        step = max(1, SCORE_CELLS // len(who))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                ids, tf = (batch[c].flatten().to_numpy(zero_copy_only=False) for c in ("ids", "counts"))
                row = np.repeat(np.arange(batch.num_rows), batch["ids"].value_lengths().to_numpy(zero_copy_only=False))
                pairs, of = np.unique(row * len(idf) + ids, return_inverse=True)
                row, ids, tf = pairs // len(idf), pairs % len(idf), np.bincount(of, tf, len(pairs))
                length = np.where(is_ref[ids], batch["refs"].to_numpy()[row], batch["words"].to_numpy()[row])
                weight = np.floor(idf[ids] * tf / (tf + K1 * ((1 - B) + B * length / mean[ids])) * 1_000_000 + 0.5)
                times = begin[ids + 1] - begin[ids]
                first = np.cumsum(times) - times
                cell = np.repeat(row, times) * len(who) + askers[np.repeat(begin[ids] - first, times) + np.arange(times.sum())]
                scores = np.full(batch.num_rows * len(who), -1.0)
                scores[cell] = 0
                scores += np.bincount(cell, np.repeat(weight, times), len(scores))
                scores = scores.reshape(batch.num_rows, len(who))
                least = np.maximum(np.maximum(best.top[:, 0], 0), retrieval.kth(scores, k))
                which, doc = np.nonzero((scores >= least).T)
                found = scores[doc, which]
                keep = best.keep(everyone, which, retrieval.places(batch[key])[doc], found)
                if len(keep):
                    yield pa.RecordBatch.from_arrays([who.take(pa.array(which[keep])), batch[key].take(pa.array(doc[keep])), pa.array(found[keep].astype(np.int64))], ["query_id", key, "score"])

    found = counted.where(F.col(key).isNotNull()).mapInArrow(score, schema)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
