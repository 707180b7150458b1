"""Encoding and decoding as the sentencepiece library does with a BPE model, by a table of prefixes.

The library joins neighbours into the piece of the highest score, the leftmost of equals, until no two neighbours make a
piece. How two neighbouring tokens came about doesn't depend on what stands around them; so a sequence of tokens
is the encoding of its text exactly if each two neighbours, encoded alone, give these two tokens. Hence each prefix
of a text ends in one token that is right whatever follows as long as that prefix is cut there: the one that is compatible with the last
token of the prefix before it. An Aho-Corasick automaton names the pieces that end at each place, a table of the
pairs met so far says which is compatible, and one array holds the last token of each prefix. The ids are recovered from
its end backwards. Time is linear in the text, whatever stands in it.

Where no piece has the mark U+2581 behind another character, all pairs over the front of a run of marks are
compatible, so the table may start anew there; likewise between a word and a sign that follows a word in no piece, as
commas do. The ids of such a part are kept, since words repeat.

A text is normalised as such models say: a mark in front and one for each space. Characters that no token
covers go to the ids of their UTF-8 bytes. Models that say otherwise are refused.

Null and empty texts have no tokens but begin and end. Rows are kept as they are, repeated ones too; columns other
than doc_id and text are left out. A task holds one batch of texts, and four bytes for each character of one part.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.token_counts import MARK, marked

IDS = "doc_id long, ids binary"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_LOADED: dict[str, PieceBpe] = {}


class Row(dict):
    """Right token -> whether it stays beside one left token."""

    def __init__(self, table: PrefixTable, left: int) -> None:
        super().__init__()
        self.table, self.left = table, left

    def __missing__(self, right: int) -> bool:
        known = self[right] = self.table.apart(self.left, right)
        self.table.n_pairs += 1
        return known


class Rows(dict):
    """Left token -> its Row."""

    def __init__(self, table: PrefixTable) -> None:
        super().__init__()
        self.table = table

    def __missing__(self, left: int) -> Row:
        row = self[left] = Row(self.table, left)
        return row


class PrefixTable(dict):
    """Part of a normalised text -> ids as bytes. Keeps the first `limit` parts that a Python worker meets, and at most four times as many pairs.

    Characters that no piece covers stand in the table as -1 less their code point.
    """

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], limit: int = 1_000_000) -> None:
        super().__init__()
        self.pieces, self.byte_ids, self.limit = pieces, byte_ids, limit
        self.text_of = {i: p for p, (i, _) in pieces.items()}
        self.size = {i: len(p) for i, p in self.text_of.items()}
        self.steps: dict[int, list[tuple[float, str, str]]] = {}
        self.rows, self.n_pairs = Rows(self), 0
        self.found = ahocorasick.Automaton()
        for piece, (i, _) in pieces.items():
            steps = self.joins(piece)
            if len(steps) == len(piece) - 1:  # others are no token of their own text, hence of none
                self.steps[i] = steps
                self.found.add_word(piece, (len(piece), i))
        self.found.make_automaton()
        self.parts = self._splitter()

    def _splitter(self) -> Callable[[str], list[str]]:
        """Finds the parts of a text whose borders no piece crosses: at marks, between a word and a sign that follows no word in any piece, and around white space that is in no piece."""
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            return lambda text: [text]
        held = {c for p in self.pieces for c in p}
        alone = "".join(c for c in "\n\r\t" if c not in held)
        on = {p[k] for p in self.pieces for k in range(1, len(p)) if re.match(r"\w\W", p[k - 1 : k + 1])} - {MARK}
        sign = rf"[^\w{MARK}{alone}]"
        more = f"(?:[{''.join(map(re.escape, sorted(on)))}]{sign}*\\w*)*+" if on else ""
        return re.compile((f"[{alone}]|" if alone else "") + rf"{MARK}*{sign}*\w*{more}").findall

    def joins(self, text: str) -> list[tuple[float, str, str]]:
        """(score, first symbol, last symbol) after each join that a text alone goes through."""
        s, steps = list(text), []
        while True:
            best = max(((self.pieces[s[k] + s[k + 1]][1], -k) for k in range(len(s) - 1) if s[k] + s[k + 1] in self.pieces), default=None)
            if best is None:
                return steps
            k = -best[1]
            s[k : k + 2] = [s[k] + s[k + 1]]
            steps.append((best[0], s[0], s[-1]))

    def _text(self, token: int) -> str:
        return self.text_of[token] if token >= 0 else chr(-1 - token)

    def apart(self, left: int, right: int) -> bool:
        """Whether two tokens side by side stay these two.

        Goes through the joins of both, the best first and the left one of equals, and looks whether one over the border would ever come first.
        """
        a, b = self.steps.get(left, ()), self.steps.get(right, ())
        end, begin = self._text(left)[-1], self._text(right)[0]
        i = j = 0
        while True:
            over = self.pieces.get(end + begin)
            if over and (i == len(a) or over[1] > a[i][0]) and (j == len(b) or over[1] >= b[j][0]):
                return False
            if i < len(a) and (j == len(b) or a[i][0] >= b[j][0]):
                end = a[i][2]
                i += 1
            elif j < len(b):
                begin = b[j][1]
                j += 1
            else:
                return True

    def last_tokens(self, text: str) -> array:
        """For each prefix of a text, the last token of its encoding; at 0 nothing."""
        if self.n_pairs > 4 * self.limit:
            self.rows, self.n_pairs = Rows(self), 0
        last = array("i", bytes(4)) * (len(text) + 1)
        row_of, rows = self.rows, [None] * (len(text) + 1)  # the pairs of each prefix's last token
        done = 0  # prefixes up to here have their last token
        for at, (size, token) in self.found.iter(text):
            if at < done:
                continue
            while done < at:  # no piece fits at this end, so its character is in none
                last[done + 1] = -1 - ord(text[done])
                done += 1
                rows[done] = row_of[last[done]]
            if size > at or rows[at + 1 - size][token]:
                done = at + 1
                last[done] = token
                rows[done] = row_of[token]
        for k in range(done, len(text)):
            last[k + 1] = -1 - ord(text[k])
        return last

    def encoded(self, text: str) -> list[int]:
        """Ids of one part, recovered from its end backwards."""
        last, end, ids, size = self.last_tokens(text), len(text), [], self.size
        while end:
            token = last[end]
            if token >= 0:
                ids.append(token)
                end -= size[token]
            else:
                ids += [self.byte_ids[x] for x in reversed(chr(-1 - token).encode())]
                end -= 1
        return ids[::-1]

    def __missing__(self, part: str) -> bytes:
        ids = self.encoded(part)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) < self.limit and len(part) < 256:
            self[part] = packed
        return packed


class PieceBpe:
    """The tokenizer of a model file, one for each Python worker."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        sp = SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto.FromString(sp.serialized_model_proto())
        kind, spec, trained = model.SentencePiece, model.normalizer_spec, model.trainer_spec
        plain = not spec.precompiled_charsmap and spec.add_dummy_prefix and not spec.remove_extra_whitespaces and spec.escape_whitespaces
        if trained.model_type != trained.BPE or trained.treat_whitespace_as_suffix or not plain or not trained.byte_fallback:
            raise ValueError("a BPE model with bytes to fall back on, which leaves texts as they are, is needed")
        if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces):
            raise ValueError("all pieces must be plain ones")
        joined = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        by_name = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.BYTE}
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        self.table = PrefixTable(joined, [by_name[f"<0x{x:02X}>"] for x in range(256)])
        self.raw = dict(zip(self.table.byte_ids, (bytes([x]) for x in range(256)), strict=True))
        self.unknown = trained.unk_surface
        #: What each id adds to a decoded text; control pieces add nothing.
        self.surface = [self.raw.get(i) or (p.piece.replace(MARK, " ") if p.type == kind.NORMAL else self.unknown if p.type == kind.UNKNOWN else "").encode() for i, p in enumerate(model.pieces)]
        self.opens = {i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL and p.piece.startswith(MARK)}

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text with begin and end, as little-endian unsigned 32-bit integers."""
        parts = self.table.parts(marked(text)) if text else []
        return b"".join((self.bos.to_bytes(4, "little"), *map(self.table.__getitem__, parts), self.eos.to_bytes(4, "little")))

    def decode(self, ids: list[int]) -> bytes:
        """As the library's decode(), in UTF-8: the space that was put in front goes, bytes that are no UTF-8 give U+FFFD each."""
        found = list(map(self.surface.__getitem__, ids))
        within = found.count(b"") > sum(not x for x in (found[:1] + found[1:][-1:]))  # control ids there part runs of bytes
        first = next((k for k, x in enumerate(found) if x), None)
        if first is not None and ids[first] in self.opens:
            found[first] = found[first][1:]
        whole = b"".join(found)
        try:
            whole.decode()
        except UnicodeDecodeError:
            within = True
        return self._patched(ids, found) if within else whole

    def _patched(self, ids: list[int], found: list[bytes]) -> bytes:
        out: list[str] = []
        held = b""
        for i, x in zip([*ids, None], [*found, b""], strict=True):
            if i in self.raw:
                held += x
                continue
            while held:  # a run of bytes: the longest character that begins here, else one sign for one byte
                size = next((n for n in range(1, 5) if self._is_character(held[:n])), 0)
                out.append(held[:size].decode() if size else "�")
                held = held[size or 1 :]
            out.append(x.decode())
        return "".join(out).encode()

    @staticmethod
    def _is_character(raw: bytes) -> bool:
        try:
            return len(raw.decode()) == 1
        except UnicodeDecodeError:
            return False


def load(path: str) -> PieceBpe:
    if path not in _LOADED:
        _LOADED[path] = PieceBpe(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, path: str, then: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, schema: str = IDS) -> DataFrame:
    """One row for each row of docs: doc_id, ids binary (little-endian unsigned 32-bit, begin and end among them).

    path: a model file that every executor can open. then: applied to each batch of such rows in the worker that made it; `schema` is that of its result.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                rows = batch.slice(at, 200)
                ids = pa.array(map(bpe.encode, rows["text"].to_pylist()), pa.binary())
                ids = pa.RecordBatch.from_arrays([rows["doc_id"], ids], ["doc_id", "ids"])
                yield then(ids) if then else ids

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encoded, schema)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text: what the library's decode() gives for the ids."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = [bpe.decode(np.frombuffer(x or b"", "<u4").tolist()).decode() for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decoded, "doc_id long, text string")


def digest(path: str) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """For encode_documents(then=...): DIGESTS of the ids and of what they decode to."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe, rows = load(path), batch["ids"].to_pylist()
        columns = [
            batch["doc_id"],
            pa.array([len(x) // 4 for x in rows], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in rows], pa.string()),
            pa.array([hashlib.sha256(bpe.decode(np.frombuffer(x, "<u4").tolist())).hexdigest() for x in rows], pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return of
