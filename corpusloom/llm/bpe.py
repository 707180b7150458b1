"""BPE encoding and decoding of whole texts, by tree concatenation.

A text is halved, wherever the middle falls, down to leaves of TEXT_LEAF bytes, and its leaves are encoded alone. Then two
neighbours become one, up to the whole: a window around their border is encoded again, twice as wide each time,
until both of its ends have the ids that they had. Words between ASCII white space are independent of each other for a
tokenizer whose pre-tokenizer never crosses white space, so windows are counted in words, their ids are kept in the worker, and agreement of
the words at both ends makes the joined sequence the encoding of the whole. A leaf has few words, but one of them may be
as long as it likes: a word that no rule splits is a tree of its own (over LEAF characters), whose windows are counted in tokens. Two neighbours
of a BPE sequence that are neighbours in some encoding stay so in any, hence agreement is enough there, too.

Where no tree is asked for (`whole`), a text is one leaf: the same ids, without joins. Arrow tells the words of many texts apart
there, so that each distinct one is looked up once for all of them, and strings their ids together.

Texts over `split_chars` code points are cut into rows, so that their parts are encoded by several
tasks, and joined per document.

Null and empty texts give no ids. Rows are kept as they are, repeated ones too.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.words import SPACE
from corpusloom.llm.workers import take_turn, trimmed

#: A text between white space of more code points than this goes pre-token by pre-token, each a tree if it is over LEAF.
LONG = 512
LEAF = 4096
#: Bytes of a leaf of a text's tree.
TEXT_LEAF = 1024
_LOADED: dict[str, WordBpe] = {}


class Merges:
    """Merges many short words at once: each step joins, in every word, its lowest-ranked pair, the leftmost of equals."""

    NONE = np.iinfo(np.int32).max

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str) -> None:
        n = len(suffix)
        self.size = len(vocab)
        left, right = (np.asarray([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        made = [vocab[a + b] if not n or not a.endswith(suffix) else -1 for a, b in merges]
        key = left * self.size + right
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], order.astype(np.int32), np.asarray(made, np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (left >= 0) & (right >= 0), self.rank[at], self.NONE)

    def merge(self, symbols: np.ndarray) -> np.ndarray:
        """symbols: a row for each word, -1 after its end. The rows after all merges."""
        out, rows = symbols.copy(), np.arange(len(symbols))
        s = symbols
        r = self.ranks(s[:, :-1], s[:, 1:])
        column = np.arange(s.shape[1])[None, :]
        while len(rows):
            at = np.argmin(r, axis=1)
            best = r[np.arange(len(r)), at]
            done = best == self.NONE
            if done.any():
                out[rows[done]] = s[done]
                go = ~done
                rows, s, r, at, best = rows[go], s[go], r[go], at[go], best[go]
                if not len(rows):
                    break
            every = np.arange(len(s))
            shifted = np.concatenate([s[:, 1:], np.full((len(s), 1), -1, s.dtype)], axis=1)
            s = np.where(column > at[:, None], shifted, s)
            s[every, at] = self.made[best]
            late = np.concatenate([r[:, 1:], np.full((len(r), 1), self.NONE, r.dtype)], axis=1)
            r = np.where(column[:, :-1] > at[:, None], late, r)
            last = np.minimum(at, r.shape[1] - 1)
            r[every, last] = np.where(at < r.shape[1], self.ranks(s[every, last], s[every, last + 1]), r[every, last])
            before = at > 0
            r[every[before], at[before] - 1] = self.ranks(s[every[before], at[before] - 1], s[every[before], at[before]])
        return out


#: Bytes of a word that Merges takes; longer ones go to the library.
SHORT = 24
#: What may follow a word of letters for the fast way.
_STOPS = ".,;:!?$%&*#|"
#: Words that Merges takes at a time: what it works on stays in the processor's cache.
TOGETHER = 4096


#: Words of a part of a text, and the ids of each.
Node = tuple[list[bytes], list[bytes]]


def _cuts(raw: bytes) -> list[int]:
    """Where a text is cut into its leaves: halved until they have at most TEXT_LEAF bytes, but for the rest of a character."""
    n = 1
    while len(raw) > n * TEXT_LEAF:
        n *= 2
    cuts = [len(raw) * k // n for k in range(n + 1)]
    for k in range(1, n):
        while raw[cuts[k]] & 0xC0 == 0x80:
            cuts[k] -= 1
    return cuts


def _inside(raw: bytes, at: int) -> bool:
    """Whether a word runs over a place."""
    return raw[at - 1] not in SPACE and raw[at] not in SPACE


def _listed(words: pa.Array) -> list[bytes]:
    """Words without line ends, as to_pylist() gives them, many times faster."""
    every = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
    return pc.binary_join(every, "\n")[0].as_buffer().to_pybytes().split(b"\n") if len(words) else []


def _parts(codes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    """Strings that stand in `codes`, by their places and sizes."""
    ends = np.append(0, np.cumsum(size)).astype(np.int32)
    at = np.arange(ends[-1]) + np.repeat(begin - ends[:-1], size)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(codes[at])))


class WordBpe:
    """The tokenizer of a tokenizers file (BPE, white space dropped by the pre-tokenizer), one per Python worker.

    Keeps the ids of the first `words` words, or words without capitals and stops, that it meets in its turn; the others are encoded anew.
    """

    def __init__(self, path: str, words: int = 250_000) -> None:
        from tokenizers import Tokenizer

        self.path, self.limit = path, words
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        spec = json.loads(self.tok.to_str())
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix"):
            raise ValueError("a plain BPE model is needed")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must match as they stand")
        self.n_ids = self.tok.get_vocab_size(with_added_tokens=True)
        self.tokens = [(self.tok.id_to_token(i) or "").encode() for i in range(self.n_ids)]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.whole = self.tok.model
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        self.symbols = self._fast_symbols(vocab)
        self.merges = Merges(vocab, self._pairs(model), self.suffix) if self.symbols is not None else None
        self.words: dict[bytes, bytes] = {}
        #: Joins made, and windows encoded for them.
        self.joins = self.windows = 0

    @staticmethod
    def _pairs(model: dict) -> list[tuple[str, str]]:
        return [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]

    @functools.cached_property
    def inner(self):
        """Encodes a part of a word that is not its end."""
        from tokenizers.models import BPE

        model = json.loads(self.tok.to_str())["model"]
        return BPE(vocab=model["vocab"], merges=self._pairs(model)) if self.suffix else self.whole

    def _fast_symbols(self, vocab: dict[str, int]) -> np.ndarray | None:
        """For each byte its id inside a word and at its end, if lower-casing letters below U+0250 and merging is all that the pipeline does to a word of them."""
        if not (self.tok.normalizer and self.tok.pre_tokenizer):
            return None
        probe = "".join(chr(c) for c in range(0x61, 0x250) if chr(c).isalpha() and chr(c) == chr(c).lower())
        word = [x for x, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(probe))]
        if len(word) != 1 or len(word[0]) != len(probe.encode()) or self.tok.normalizer.normalize_str("AZÀÖØÞĀĐ") != "azàöøþāđ":
            return None
        out = np.full((2, 256), -1, np.int32)
        for byte, char in zip(probe.encode(), word[0], strict=True):
            out[:, byte] = vocab.get(char, -1), vocab.get(char + self.suffix, -1)
        return out if (out[0][list(set(probe.encode()))] >= 0).all() and (out[1][list(set(probe.encode()))] >= 0).all() else None

    def _cores(self, cores: list[bytes]) -> dict[bytes, bytes]:
        """Ids of lower-case words of letters below U+0250, of at most SHORT bytes; words of like lengths go together."""
        cores = sorted(cores, key=len)
        return {core: ids for at in range(0, len(cores), TOGETHER) for core, ids in self._merged(cores[at : at + TOGETHER])}

    def _merged(self, cores: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        size = np.fromiter(map(len, cores), np.int64, len(cores))
        raw = np.frombuffer(b"".join(cores), np.uint8)
        row = np.repeat(np.arange(len(cores)), size)
        place = np.arange(len(raw)) - np.repeat(np.cumsum(size) - size, size)
        symbols = np.full((len(cores), max(2, int(size.max()))), -1, np.int32)
        symbols[row, place] = self.symbols[(place == size[row] - 1).astype(np.int64), raw]
        ids = self.merges.merge(symbols)
        held = ids >= 0
        data = ids[held].astype("<u4").tobytes()
        ends = 4 * np.cumsum(held.sum(axis=1))
        return zip(cores, [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)], strict=True)

    def _fit(self, stems: pa.Array) -> np.ndarray:
        """Which lower-case words _cores() takes."""
        if self.symbols is None:
            return np.zeros(len(stems), bool)
        ends = np.frombuffer(stems.buffers()[1], np.int32)[: len(stems) + 1]
        codes = np.frombuffer(stems.buffers()[2] or b"", np.uint8)[: ends[-1]]
        fit = pc.utf8_is_alpha(stems).to_numpy(zero_copy_only=False) & (np.diff(ends) <= SHORT)
        after = np.append(codes[1:], 0)
        high = np.flatnonzero((codes > 0xC9) | (codes == 0xC9) & (after >= 0x90))  # where characters from U+0250 on begin
        fit[np.searchsorted(ends, high, side="right") - 1] = False
        return fit

    def learn(self, words: list[bytes]) -> pa.Array:
        """Ids of distinct words. Those of letters and stops after them come from their letters, which are merged; others from the library. What is new of these two is kept in self.words, up to its limit."""
        if not words:
            return pa.array([], pa.binary())
        known, before = self.words, len(self.words)
        # Lower-case words with a line end each; from here on all of them go together.
        low = ((b"\n".join(words)).decode().lower() + "\n").encode()
        codes = np.frombuffer(low, np.uint8)
        ends = np.append(0, np.flatnonzero(codes == 10) + 1).astype(np.int32)
        bare = pc.utf8_rtrim(pa.StringArray.from_buffers(len(words), pa.py_buffer(ends), pa.py_buffer(low)), _STOPS + "\n")
        size = pc.binary_length(bare).to_numpy()
        tails = _parts(codes, ends[:-1] + size, np.diff(ends) - size - 1).dictionary_encode()
        stems = bare.dictionary_encode()
        fit = self._fit(stems.dictionary)
        cores = _listed(stems.dictionary)
        found = list(map(known.get, cores))
        made = self._cores([core for core, ids, ok in zip(cores, found, fit.tolist(), strict=True) if ok and ids is None])
        known |= made
        found = [made.get(core, b"") if ids is None else ids for core, ids in zip(cores, found, strict=True)]
        ends_of = [self._kept(tail) for tail in _listed(tails.dictionary)]
        ids = pc.binary_join_element_wise(pa.array(found, pa.binary()).take(stems.indices), pa.array(ends_of, pa.binary()).take(tails.indices), b"")
        other = ~fit[stems.indices.to_numpy()]
        if other.any():
            ids = pc.replace_with_mask(ids, pa.array(other), pa.array([self._kept(words[i]) for i in np.flatnonzero(other).tolist()], pa.binary()))
        self._shorten(before)
        return ids

    def _kept(self, word: bytes) -> bytes:
        if word not in self.words:
            self.words[word] = self._pack(self._any(word.decode()))
        return self.words[word]

    def _shorten(self, before: int) -> None:
        """Forget what came last, over the limit; there were `before` words that were kept."""
        while len(self.words) > max(before, self.limit):
            self.words.popitem()

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return np.asarray(ids, "<u4").tobytes()

    def _any(self, text: str) -> list[int]:
        if len(text) < LONG:
            return self.tok.encode(text, add_special_tokens=False).ids
        ids: list[int] = []
        for pre, whole in self.pre_tokens(text):
            ids += [pre] if isinstance(pre, int) else self.tree(pre, whole)
        return ids

    def pre_tokens(self, text: str) -> Iterator[tuple[str | int, bool]]:
        """What the model gets of a text, in order, and the ids of added tokens in it."""
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.added:
                yield self.added[part], True
            elif part:
                part = self.tok.normalizer.normalize_str(part) if self.tok.normalizer else part
                for pre, _ in self.tok.pre_tokenizer.pre_tokenize_str(part):
                    yield pre, True

    def base(self, pre: str, end: bool) -> list[int]:
        return [t.id for t in (self.whole if end else self.inner).tokenize(pre)] if pre else []

    def tree(self, pre: str, end: bool) -> list[int]:
        """Ids of a pre-token, or of the part of one that does not reach its end."""
        if len(pre) <= LEAF:
            return self.base(pre, end)
        half = len(pre) // 2
        return self.join(self.tree(pre[:half], False), self.tree(pre[half:], end), end)

    def text_of(self, ids: list[int]) -> str:
        """The text of neighbouring tokens of one pre-token, without the end-of-word mark."""
        return "".join(x.removesuffix(self.suffix) if self.suffix else x for x in (self.tokens[i].decode() for i in ids))

    def join(self, left: list[int], right: list[int], end: bool) -> list[int]:
        """One sequence from the encodings of two neighbours; end: the right one ends the pre-token."""
        width = 8
        while True:
            i, j = max(0, len(left) - width), min(width, len(right))
            again = self.base(self.text_of(left[i:] + right[:j]), end and j == len(right))
            if (i == 0 or again[:2] == left[i : i + 2]) and (j == len(right) or again[-2:] == right[j - 2 : j]):
                return left[:i] + again + right[j:]
            width *= 2

    def _ids(self, parts: list[list[bytes]]) -> list[list[bytes]]:
        """Ids of each word of each part; words that are not known are encoded together."""
        found = [list(map(self.words.get, words)) for words in parts]
        gaps = [[] if all(ids) else [i for i, x in enumerate(ids) if x is None] for ids in found]
        missing = list({words[i] for words, gap in zip(parts, gaps, strict=True) for i in gap})
        made = dict(zip(missing, self.learn(missing).to_pylist(), strict=True))
        for words, ids, gap in zip(parts, found, gaps, strict=True):
            for i in gap:
                ids[i] = made[words[i]]
        before = len(self.words)
        self.words |= made
        self._shorten(before)
        return found

    def encode_whole(self, texts: pa.Array) -> pa.Array:
        """As encode(), each text as one leaf, from Arrow to Arrow: the distinct words of all texts are learnt at once."""
        take_turn(self.words)
        parts = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        words = parts.flatten().dictionary_encode()
        # Where a text has white space at its ends, the empty word is among them; it has no ids.
        found = self.learn(_listed(words.dictionary)).take(words.indices)
        return pc.binary_join(pa.ListArray.from_arrays(parts.offsets, found), b"")

    def encode(self, texts: list[str | None], whole: bool = False) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers: leaves of all texts together, then their joins, a level of all trees at a time. whole: each text is one leaf."""
        if whole:
            return self.encode_whole(pa.array(texts, pa.string())).to_pylist()
        take_turn(self.words)
        raws = [t.encode() if t else b"" for t in texts]
        cuts = [_cuts(raw) for raw in raws]
        leaves = [raw[a:b].split() for raw, at in zip(raws, cuts, strict=True) for a, b in zip(at, at[1:], strict=False)]
        ids, begin, trees = self._ids(leaves), 0, []
        for at in cuts:
            trees.append(list(zip(leaves[begin : begin + len(at) - 1], ids[begin : begin + len(at) - 1], strict=True)))
            begin += len(at) - 1
        step = 1
        while any(len(nodes) > 1 for nodes in trees):
            pairs = [(nodes[k], nodes[k + 1], _inside(raw, at[(k + 1) * step])) for raw, at, nodes in zip(raws, cuts, trees, strict=True) for k in range(0, len(nodes) - 1, 2)]
            joined = iter(self.joined(pairs))
            trees = [[next(joined) for _ in range(0, len(nodes) - 1, 2)] if len(nodes) > 1 else nodes for nodes in trees]
            step *= 2
        return [b"".join(nodes[0][1]) for nodes in trees]

    def joined(self, pairs: list[tuple[Node, Node, bool]]) -> list[Node]:
        """One node from each two neighbours (and whether a word runs over their border): windows around the borders are encoded again, twice as wide each time, until both ends have the ids that they had."""
        out: list[Node | None] = [None] * len(pairs)
        width, left = 1, list(range(len(pairs)))
        while left:
            windows = []
            for p in left:
                (one, _), (two, _), inside = pairs[p]
                windows.append((b" ".join(one[-width:]) + (b"" if inside else b" ") + b" ".join(two[:width])).split())
            again = []
            for p, words, ids in zip(left, windows, self._ids(windows), strict=True):
                (one, before), (two, after), _ = pairs[p]
                i, j = max(0, len(one) - width), min(width, len(two))
                if (i == 0 or ids[0] == before[i]) and (j == len(two) or ids[-1] == after[j - 1]):
                    out[p] = one[:i] + words + two[j:], before[:i] + ids + after[j:]
                else:
                    again.append(p)
            self.joins += len(left) - len(again)
            self.windows += len(left)
            width, left = 2 * width, again
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """As the library's decode() without a decoder: the tokens, joined by one space."""
        return b" ".join(map(self.tokens.__getitem__, ids.tolist()))


def load(path: str) -> WordBpe:
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def _pieces(text: str, bpe: WordBpe, size: int) -> Iterator[tuple[int, bool, str]]:
    """(0, True, words) or, for pre-tokens of over `size`, (their number, whether it is the last part, part)."""
    held: list[str] = []
    room, number = size, 0
    for word in text.encode().split():
        word = word.decode()
        if len(word) <= size:
            held.append(word)
            room -= len(word) + 1
            if room <= 0:
                yield 0, True, " ".join(held)
                held, room = [], size
            continue
        if held:
            yield 0, True, " ".join(held)
            held, room = [], size
        for pre, _ in bpe.pre_tokens(word):
            number += 1
            pre = bpe.tokens[pre].decode() if isinstance(pre, int) else pre
            cuts = range(0, len(pre), size)
            for at in cuts:
                yield (number if pre not in bpe.added else -number), at == cuts[-1], pre[at : at + size]
    if held:
        yield 0, True, " ".join(held)


_LONG_SCHEMA = "_row long, doc_id long, seq int, pre int, last boolean, part string"


#: Rows encoded together; without trees rows of so many bytes, or one of more.
SLICE, SLICE_BYTES = 400, 4 << 20
IDS = "doc_id long, ids binary"


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of SLICE_BYTES of text at most, or one of more."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy().astype(np.int64))
    at = 0
    while at < batch.num_rows:
        begin = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, begin + SLICE_BYTES, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def encode_documents(docs: DataFrame, path: str, split_chars: int = 1 << 20, then: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, schema: str = IDS, whole: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, ids binary (little-endian unsigned 32-bit).

    path: a tokenizers file that every executor can open. Columns other than doc_id and text are left out.
    then: applied to each batch of such rows, in the worker that made it; `schema` is that of its result.
    whole: texts are encoded without trees of leaves; the ids don't depend on it.
    """

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in trimmed(batches):
            for part in _slices(batch) if whole else (batch.slice(at, SLICE) for at in range(0, batch.num_rows, SLICE)):
                encoded = bpe.encode_whole(part["text"]) if whole else pa.array(bpe.encode(part["text"].to_pylist()), pa.binary())
                ids = pa.RecordBatch.from_arrays([part["doc_id"], encoded], ["doc_id", "ids"])
                yield then(ids) if then else ids

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(then, batches)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for row, doc_id, text in zip(*(batch[c].to_pylist() for c in ("_row", "doc_id", "text")), strict=True):
                for seq, (pre, last, part) in enumerate(_pieces(text, bpe, split_chars)):
                    yield pa.RecordBatch.from_pylist([{"_row": row, "doc_id": doc_id, "seq": seq, "pre": pre, "last": last, "part": part}], pa.schema([("_row", pa.int64()), ("doc_id", pa.int64()), ("seq", pa.int32()), ("pre", pa.int32()), ("last", pa.bool_()), ("part", pa.string())]))

    def encode_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            ids = [
                bpe.encode([part], whole)[0] if pre == 0 else bpe._pack([bpe.added[part]]) if pre < 0 else bpe._pack(bpe.tree(part, last))
                for pre, last, part in zip(*(batch[c].to_pylist() for c in ("pre", "last", "part")), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch[c] for c in ("_row", "doc_id", "seq", "pre", "last")] + [pa.array(ids, pa.binary())], ["_row", "doc_id", "seq", "pre", "last", "ids"])

    def joined(key, pdf):
        import pandas as pd

        bpe = load(path)
        out, open_pre, held = [], 0, []
        for pre, last, ids in pdf.sort_values("seq")[["pre", "last", "ids"]].itertuples(index=False):
            if pre > 0:
                ids = np.frombuffer(ids, "<u4").tolist()
                held = bpe.join(held, ids, last) if open_pre == pre else ids
                open_pre = pre
                if not last:
                    continue
                ids = bpe._pack(held)
            out.append(ids)
            open_pre, held = 0, []
        return pd.DataFrame({"doc_id": [pdf["doc_id"].iloc[0]], "ids": [b"".join(out)]})

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    is_long = F.length("text") > split_chars
    few = docs.where(is_long.isNull() | ~is_long).mapInArrow(short, schema)
    parts = docs.where(is_long).select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text").mapInArrow(cut, _LONG_SCHEMA)
    many = parts.repartition(F.col("_row"), F.col("seq")).mapInArrow(encode_parts, "_row long, doc_id long, seq int, pre int, last boolean, ids binary")
    whole = many.groupBy("_row").applyInPandas(joined, IDS)
    return few.unionByName(whole.mapInArrow(finished, schema) if then else whole)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text: what the library's decode(ids, skip_special_tokens=False) gives."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = [bpe.decode(np.frombuffer(x, "<u4")).decode() for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digest(path: str) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """For encode_documents(then=...): DIGESTS of the ids and of what they decode to."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe, rows = load(path), batch["ids"].to_pylist()
        columns = [
            batch["doc_id"],
            pa.array([len(x) // 4 for x in rows], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in rows], pa.string()),
            pa.array([hashlib.sha256(bpe.decode(np.frombuffer(x, "<u4"))).hexdigest() for x in rows], pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return of
