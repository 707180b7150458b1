"""Token counts by a count-only Viterbi.

An Aho-Corasick automaton over a unigram vocabulary enumerates the pieces in a word; dynamic
programming over their ends carries the best score and the number of pieces, and no back pointers.
Ties go as in unigram tokenizers: candidates come by start, and one replaces another only if its
score is higher, so the longest last piece wins. A character that is no piece is unknown: it costs
the lowest score less 10, and unknown neighbours are one token, or with byte fallback the tokens of its bytes.

A text is normalised as the model's file says: for models that leave texts as they are, one mark U+2581 in
front and one for each space; other characters, newlines and tabs too, are pieces or unknown. Where no piece
has the mark after another character, no path crosses the front of a run of marks, and with byte fallback none
crosses a newline or tab that is in no piece. Parts between such places are independent and their counts are
cached, if all scores are whole numbers, whose sums are exact in any order. With other vocabularies the
path is searched over the whole text, and sums are made in the order of the text.

Null and empty texts have no tokens. Rows are counted one by one, so repeated rows, ties and extra
columns have no effect.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
PENALTY = 10.0
_LOADED: dict[str, tuple[UnigramCounter, Callable[[str], str]]] = {}


def sentencepiece_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) by id; control and unknown pieces are empty strings."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    return [("" if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) else sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


def marked(text: str) -> str:
    """The text with a mark in front and one for each space."""
    return MARK + text.replace(" ", MARK) if text else ""


def sentencepiece_normalizer(path: str) -> Callable[[str], str]:
    """The normaliser of a model's file, in its short form where the model leaves texts as they are."""
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    sp = SentencePieceProcessor(model_file=path)
    spec = sentencepiece_model_pb2.ModelProto.FromString(sp.serialized_model_proto()).normalizer_spec
    plain = not spec.precompiled_charsmap and spec.add_dummy_prefix and not spec.remove_extra_whitespaces and spec.escape_whitespaces
    return marked if plain else sp.normalize


class UnigramCounter(dict):
    """Part of a normalised text -> (pieces, score). Keeps the first `limit` parts of a Python worker."""

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True, limit: int = 500_000) -> None:
        super().__init__()
        self.limit, self.byte_fallback = limit, byte_fallback
        pieces = {p: s for p, s in vocabulary if p}
        whole = all(s == int(s) for _, s in vocabulary)
        #: Finds the independent parts of a text; None if the whole text is one.
        self.parts = None
        if whole and MARK in pieces and not any(MARK in p.lstrip(MARK) for p in pieces):
            alone = "".join(c for c in "\n\t" if byte_fallback and not any(c in p for p in pieces))
            self.parts = re.compile(f"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" + (f"|[{alone}]" if alone else "")).findall
        self.unknown = min(s for _, s in vocabulary) - PENALTY
        self.singles = {p for p in pieces if len(p) == 1}
        self.found = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.found.add_word(piece, (len(piece), score))
        self.found.make_automaton()

    def count(self, word: str) -> tuple[int, float]:
        """Pieces and score of the best path over one word, its mark included."""
        n = len(word)
        if self.singles.issuperset(word):  # every character is a piece, so none is unknown
            top, pieces = [0.0] + [-math.inf] * n, [0] * (n + 1)
            for last, (length, score) in self.found.iter(word):  # longest first at each end
                total = top[last + 1 - length] + score
                if total > top[last + 1]:
                    top[last + 1], pieces[last + 1] = total, pieces[last + 1 - length] + 1
            return pieces[n], top[n]
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for last, hit in self.found.iter(word):
            ending[last].append(hit)
        best = [0.0] * (n + 1)
        count = [0] * (n + 1)
        loose = [False] * (n + 1)  # whether the best path ends with an unknown character
        for end in range(1, n + 1):
            top = None
            for length, score in sorted(ending[end - 1], reverse=True):
                total = best[end - length] + score
                if top is None or total > top:
                    top, at, unknown = total, end - length, False
            if not any(length == 1 for length, _ in ending[end - 1]):
                total = best[end - 1] + self.unknown
                if top is None or total > top:
                    top, at, unknown = total, end - 1, True
            best[end], loose[end] = top, unknown
            if not unknown:
                count[end] = count[at] + 1
            elif self.byte_fallback:
                count[end] = count[at] + len(word[at].encode())
            else:
                count[end] = count[at] + (not loose[at])
        return count[n], best[n]

    def __missing__(self, part: str) -> tuple[int, float]:
        value = self.count(part)
        if len(self) < self.limit and len(part) < 256:
            self[part] = value
        return value

    def count_text(self, text: str) -> tuple[int, float]:
        """Pieces and score of the best path over a whole normalised text."""
        if self.parts is None:
            return self.count(text)
        got = list(map(self.__getitem__, self.parts(text)))
        return sum(n for n, _ in got), float(sum(score for _, score in got))


def load(path: str) -> tuple[UnigramCounter, Callable[[str], str]]:
    if path not in _LOADED:
        _LOADED[path] = UnigramCounter(sentencepiece_vocabulary(path)), sentencepiece_normalizer(path)
    return _LOADED[path]


def token_counts(docs: DataFrame, path: str, white_space: bool = True) -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, score. path: a sentencepiece model that every executor can open.

    white_space: count the whole text, as said above; if not, only its words, split at ASCII white space, each with a mark in front.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, normal = load(path)
        for batch in batches:
            n, scores = [], []
            for text in batch["text"].to_pylist():
                text = text or ""
                parts = [normal(text)] if white_space else [MARK + w.decode() for w in text.encode().split()]
                got = list(map(held.count_text, parts))
                n.append(sum(x for x, _ in got))
                scores.append(float(sum(x for _, x in got)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(scores, pa.float64())], ["doc_id", "n_tokens", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(counted, "doc_id long, n_tokens long, score double")
