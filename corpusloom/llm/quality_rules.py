"""Quality rules, with suffix-array repetition.

The words of a text are sorted as suffixes, by rank doubling. Between neighbours of that order the
longest common prefixes (LCP) bound the intervals of maximal repeated substrings; those of at least
`min_repeat` words have their spans united. A text is kept if the united spans cover at most
`max_covered` of its words and the longest repeat has at most `max_longest` words,
however long the text is.

Many texts are sorted at once: the document number is part of the first rank, so no suffix is ever
equal to one of another text. Null, empty and all-space texts have zero words and fail the base
rules. Rows are judged one by one, so repeated rows, ties and extra columns have no effect.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.words import HASHES, SPACE
from corpusloom.llm.workers import trimmed

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: Words sorted together; a single longer text is sorted alone.
BATCH_WORDS = 400_000

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")


@dataclass(frozen=True)
class Limits:
    """Repeats of min_repeat words or more may cover max_covered of the words; the longest may have max_longest words."""

    min_repeat: int = 10
    max_covered: float = 0.25
    max_longest: int = 64


def suffix_ranks(words: np.ndarray, doc: np.ndarray, size: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Ranks of the suffixes by their first 1, 2, 4, ... words, until none are equal; and the end of each one's text.

    A rank is the place of the suffix's group in the sorted order, so equal ranks mark equal prefixes.
    """
    n = len(words)
    ends = np.repeat(np.cumsum(size), size)
    order = np.lexsort((words, doc))
    w, d = words[order], doc[order]
    new = np.r_[True, (w[1:] != w[:-1]) | (d[1:] != d[:-1])] if n else np.empty(0, bool)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    ranks, k = [rank], 1
    tied = order[~(new & np.r_[new[1:], True])] if n else order
    while len(tied):
        after = tied + k
        key = (rank[tied] << 32) | np.where(after < ends[tied], rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        tied, key = tied[by], key[by]
        high = key >> 32
        place = np.arange(len(key))
        head = np.maximum.accumulate(np.where(np.r_[True, high[1:] != high[:-1]], place, 0))
        new = np.r_[True, key[1:] != key[:-1]]
        sub = np.maximum.accumulate(np.where(new, place, 0))
        rank = rank.copy()
        rank[tied] = high + sub - head
        ranks.append(rank)
        tied = tied[~(new & np.r_[new[1:], True])]
        k *= 2
    return ranks, ends


def longest_repeats(ranks: list[np.ndarray]) -> np.ndarray:
    """For each suffix the longest prefix that another suffix of the same text shares: the larger of its two LCPs."""
    n = len(ranks[0])
    order = np.empty(n, np.int64)
    order[ranks[-1]] = np.arange(n)
    a, b = order[:-1], order[1:]
    pair = np.flatnonzero(ranks[0][a] == ranks[0][b])
    x, y = a[pair], b[pair]
    common = np.zeros(len(pair), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        r = ranks[level]
        i, j = x + common, y + common
        inside = (i < n) & (j < n)
        same = inside & (r[np.minimum(i, n - 1)] == r[np.minimum(j, n - 1)])
        common += same * (1 << level)
    out = np.zeros(n, np.int64)
    np.maximum.at(out, x, common)
    np.maximum.at(out, y, common)
    return out


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the spans."""
    edge = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(starts + lengths, minlength=n + 1)[: n + 1]
    return np.cumsum(edge)[:n] > 0


def _repetition(hashes: list[np.ndarray], min_repeat: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: words in repeated windows of 8, words in maximal repeats of min_repeat or more, longest repeat."""
    size = np.asarray([len(h) for h in hashes], np.int64)
    n, texts = int(size.sum()), len(hashes)
    if not n:
        return (np.zeros(texts, np.int64),) * 3
    doc = np.repeat(np.arange(texts), size)
    ranks, _ = suffix_ranks(np.concatenate(hashes), doc, size)
    longest = longest_repeats(ranks)
    windows = np.flatnonzero(longest >= WINDOW)
    in_window = covered(windows, np.full(len(windows), WINDOW), n)
    spans = np.flatnonzero(longest >= min_repeat)
    in_span = covered(spans, longest[spans], n)
    top = np.zeros(texts, np.int64)
    np.maximum.at(top, doc, longest)
    return np.bincount(doc, in_window, texts).astype(np.int64), np.bincount(doc, in_span, texts).astype(np.int64), top


def judge(texts: list[str | None], limits: Limits) -> dict[str, np.ndarray]:
    """STATS of each text, base_failed and kept."""
    out: list[np.ndarray] = []
    base, hashes, held = [], [], 0
    for k, text in enumerate(texts):
        raw = (text or "").encode()
        words = raw.split()
        lines = [x for x in raw.split(b"\n") if x.strip(SPACE)]
        dense = raw.translate(None, SPACE)
        chars = len(dense) if dense.isascii() else len(dense.decode())
        hashes.append(HASHES.of(words))
        base.append((len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines))))
        held += len(words)
        if held > BATCH_WORDS or k == len(texts) - 1:
            out.append(np.vstack([np.asarray(base, np.int64).T, *_repetition(hashes, limits.min_repeat)]))
            base, hashes, held = [], [], 0
    columns = np.concatenate(out, axis=1) if out else np.empty((len(STATS), 0), np.int64)
    got = dict(zip(STATS, columns, strict=True))
    n = got["n_words"]
    got["base_failed"] = (n < 20) | (100 * got["n_repeat_words"] > 30 * n)
    fine = (got["covered_words"] <= limits.max_covered * n) & (got["longest_repeat"] <= limits.max_longest)
    got["kept"] = ~got["base_failed"] & fine
    return got


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_words long, longest_repeat long"


def quality_rules(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, the base statistics, base_failed, kept, covered_words, longest_repeat."""
    limits = limits or Limits()
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            got = judge(batch["text"].to_pylist(), limits)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(got[x]) for x in names[1:])], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judged, SCHEMA)


def keep_documents(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns and without a shuffle."""
    limits = limits or Limits()

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            yield batch.filter(pa.array(judge(batch["text"].to_pylist(), limits)["kept"]))

    return docs.mapInArrow(kept, docs.schema)
