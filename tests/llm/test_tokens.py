"""BPE, packing and unigram counts against the tokenizer libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models

from corpusloom.llm import bpe, packing, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
TOK = Tokenizer.from_file(PATH)
BPE = bpe.load(PATH)
TEXTS = [None, "", " \t\n", "Hello world", "hello  WORLD", "naïve İstanbul ΣΑΣ ŒUVRE", "a<|endoftext|>b <|startoftext|>", "it's we'll", "日本語 \U0001f600!!", "x" * 30000, "ab" * 9000 + ".", "1234567890" * 700, "Hello world"]
SCHEMA = "doc_id long, text string, ids string, extra int"


def want(text):
    return TOK.encode(text or "", add_special_tokens=False).ids


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)] + [(0, t, "clash", 1) for t in texts[:1]], SCHEMA)


@given(st.lists(st.text(max_size=60), max_size=8))
@settings(max_examples=60, deadline=None)
def test_any_text(texts):
    for text, ids in zip(texts, BPE.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want(text)


@given(st.text(alphabet="abcdeé'1", min_size=300, max_size=3000), st.integers(1, 2999))
@settings(max_examples=40, deadline=None)
def test_any_join(text, cut):
    """Halves of an unsplit word, joined, are the encoding of the whole."""
    word = "".join(c for c in text if c in "abcdé") or "a"
    (pre, _), *_ = BPE.pre_tokens(word)
    cut %= len(pre)
    assert BPE.join(BPE.base(pre[:cut], False), BPE.base(pre[cut:], True), True) == BPE.base(pre, True)
    assert BPE.tree(pre, True) == BPE.base(pre, True)


def test_documents_long_ones_by_parts(spark):
    for split in (1 << 20, 500):
        got = bpe.encode_documents(frame(spark), PATH, split_chars=split, then=bpe.digest(PATH), schema=bpe.DIGESTS).collect()
        assert len(got) == len(TEXTS) + 1
        for r in got:
            ids = np.asarray(want(TEXTS[r.doc_id]), "<u4")
            assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
            assert r.decoded_sha256 == hashlib.sha256(TOK.decode(ids.tolist(), skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_documents(frame(spark, []), PATH).count() == 0


def test_decoding(spark):
    got = {r.doc_id: r.text for r in bpe.decode_documents(bpe.encode_documents(frame(spark), PATH), PATH).collect()}
    assert all(got[i] == TOK.decode(want(t), skip_special_tokens=False) for i, t in enumerate(TEXTS))


def test_cache_limit():
    small = bpe.WordBpe(PATH, words=3)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in small.encode(["a b c d e f", "f g."])] == [want("a b c d e f"), want("f g.")]
    assert len(small.words) <= 4


def test_packing(spark):
    texts = TEXTS[:-1]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    pieces = packing.pack_documents(rows, PATH, length=64).toPandas()
    whole = {i: np.asarray([*want(t), 1], "<u4") for i, t in enumerate(texts)}
    for doc, part in pieces.sort_values("start").groupby("doc_id"):
        assert part["start"].tolist() == [0, *part["length"].cumsum().tolist()[:-1]] and part["length"].sum() == len(whole[doc]) == part["doc_tokens"].iloc[0]
        for p in part.itertuples():
            assert p.ids_crc32 == zlib.crc32(whole[doc][p.start : p.start + p.length].tobytes())
    ends = pieces.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    for _, s in ends:
        assert s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]]
    full = ends["length"].sum()
    assert (full[:-1] == 64).all() and full.iloc[-1] <= 64 and sorted(full.index) == list(range(len(full)))
    assert packing.pack_documents(rows.where("false"), PATH).count() == 0


def test_trees_of_texts_are_reached():
    """Over the documents of the tables, leaves are joined, many of them within a word, and the ids are the library's."""
    import duckdb

    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' ORDER BY doc_id").fetchall()]
    own = bpe.WordBpe(PATH)
    got = [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)]
    assert got == [want(t) for t in texts]
    assert own.joins == sum(len(bpe._cuts((t or "").encode())) - 2 for t in texts) > 1000
    assert own.windows > own.joins


def test_packing_encodes_whole_texts_without_joins(spark, monkeypatch):
    """Without trees the ids are the library's, too, and packing asks for that, long texts included."""
    texts = [*TEXTS, "été " * 3000, "x" * 5000 + " y" * 3000, "a\x1cb " * 500]
    own = bpe.WordBpe(PATH)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts, whole=True)] == [want(t) for t in texts]
    assert own.joins == own.windows == 0
    asked, encode = [], packing.encode_documents
    monkeypatch.setattr(packing, "encode_documents", lambda *a, **kw: asked.append(kw["whole"]) or encode(*a, **kw, split_chars=4000))
    pieces = packing.pack_documents(frame(spark, texts).where("doc_id > 0"), PATH).toPandas().sort_values(["doc_id", "start"])
    assert asked == [True]
    got = pieces.groupby("doc_id")["length"].sum()
    assert got.tolist() == [len(want(t)) + 1 for t in texts[1:]]
    for i, s, n, crc in pieces[["doc_id", "start", "length", "ids_crc32"]].itertuples(index=False):
        assert crc == zlib.crc32(np.asarray([*want(texts[i]), 1][s : s + n], "<u4").tobytes())


@given(st.lists(st.none() | st.text(alphabet="abAÉé日ɏɐİKẞΣ.,&'\n \x1c\u0301<|endoftext|>0", max_size=60), max_size=6))
@settings(max_examples=150, deadline=None)
def test_any_whole_text(texts):
    for own in (BPE, bpe.WordBpe.__new__(bpe.WordBpe)):
        if own is not BPE:
            own.__dict__ |= BPE.__dict__ | {"words": {}, "limit": 2}  # the same tokenizer, that keeps hardly any words
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts, whole=True)] == [want(t) for t in texts]


def test_whole_texts_merge_a_word_once(monkeypatch):
    """Capitals and stops don't make another word of one that is kept, and a full cache keeps its words."""
    own, merged = bpe.WordBpe(PATH, words=6), []
    merge = own.merges.merge
    monkeypatch.setattr(own.merges, "merge", lambda symbols: merged.append(len(symbols)) or merge(symbols))
    for texts, new in ((["invented prose"], 2), (["Invented, PROSE&&& inVented."], 0), (["ab ba bab bba baab"], 5), (["Invented prose!"], 0)):
        merged.clear()
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts, whole=True)] == [want(t) for t in texts]
        assert sum(merged) == new
    assert len(own.words) == 6


def test_slices_of_a_batch(monkeypatch):
    """Every row once, in order; a slice has its bytes or one row."""
    monkeypatch.setattr(bpe, "SLICE_BYTES", 10)
    texts = ["x" * n if n else None for n in (3, 7, 1, 0, 25, 0, 0, 10, 11)]
    for some in (texts, texts[4:5], [None], []):
        got = [b["text"].to_pylist() for b in bpe._slices(pa.RecordBatch.from_pydict({"text": pa.array(some, pa.string())}))]
        assert [t for part in got for t in part] == some
        assert all(len(part) == 1 or sum(len(t or "") for t in part) <= 10 for part in got) and all(got)


@given(st.lists(st.text(alphabet="ab é日.\n\t'<|endoftext|>0", max_size=60), max_size=6))
@settings(max_examples=150, deadline=None)
def test_small_leaves(texts):
    """Every cut is made: leaves of three bytes."""
    leaf, bpe.TEXT_LEAF = bpe.TEXT_LEAF, 3
    try:
        assert [np.frombuffer(x, "<u4").tolist() for x in BPE.encode(texts)] == [want(t) for t in texts]
    finally:
        bpe.TEXT_LEAF = leaf


def test_unigram_counts(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    vocab = token_counts.sentencepiece_vocabulary(path)
    library = Tokenizer(models.Unigram([(p or f"\0{i}", s) for i, (p, s) in enumerate(vocab)], unk_id=0))
    counter = token_counts.UnigramCounter(vocab, byte_fallback=False)
    r = random.Random(3)
    words = ["".join(r.choices("aeiouthnrs-é☃日", k=r.randint(1, 25))) for _ in range(500)] + ["a" * 300]
    for w in words:
        assert counter.count("▁" + w)[0] == len(library.encode("▁" + w, add_special_tokens=False).ids)
    got = {x.doc_id: x.n_tokens for x in token_counts.token_counts(frame(spark), path, white_space=False).collect()}
    with_bytes = token_counts.UnigramCounter(vocab)
    assert with_bytes.count("▁𝔘")[0] == 1 + 4 and counter.count("▁𝔘𝔘")[0] == 2
    assert got == {i: sum(with_bytes.count("▁" + w.decode())[0] for w in (t or "").encode().split()) for i, t in enumerate(TEXTS)}
    assert got[0] == got[1] == got[2] == 0 and token_counts.token_counts(frame(spark, []), path).count() == 0
